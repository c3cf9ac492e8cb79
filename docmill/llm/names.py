"""Variant spellings of persons and organisations.

1. Spellings (lower case, no outer blanks) of all columns are counted once each.
2. Each is read as tokens with roles: title, given name (short forms and
   abbreviations known), initial, legal form, line of business, and the root:
   the family name or the firm's own name.
3. Roots with small edit distances are found by a symmetric-delete index: all
   strings left after up to two deletions are join keys; a true distance check
   follows, and a rarer root is taken for a misspelling of the more frequent.
   One edit decides first. Two edits lead only from a root without a neighbour
   at one edit to another such root, never to a misspelling, and only if both
   have a given name or line of business in common or one of them has none: the
   more names there are, the more of them lie two edits from the misspelling of
   another.
4. Spellings of one root with a full name form entities by given name, or by
   line of business and legal form. Shorter spellings (initial or title and
   family name, firm without its line of business) join an entity only if
   exactly one of that root has a full spelling that can be aligned with them:
   the tokens are assigned to each other at the lowest cost, initials and
   abbreviations permitted.

Only joins on roots and keys are used: no group is collected in one task.
Null and blank names are ignored, repeated rows count once per row for the
frequency only. Spellings that are mostly typed as concept, product or
location are in no entity. A spelling without a root (a given name or a title
alone) is an entity of its own. Roots under ``ROOT_LEAST`` letters are taken as
they are typed: one edit away from a short name there are too many other names.
"""

from __future__ import annotations

import math
import re
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.titles import edits
from docmill.storage import materialize

# Short forms of given names, titles, legal forms and lines of business with their abbreviations.
SHORT_FORMS = {
    "alexander": "alex sasha lex xander", "andreas": "andi andy", "benjamin": "ben benny", "christopher": "chris kit topher", "dorothea": "dora dorothy thea", "elizabeth": "liz beth betty lizzy eliza", "étienne": "tiennot", "fernando": "nando", "francisca": "paquita fran", "gabriela": "gabi gaby", "henrietta": "hetty etta", "isabella": "bella isa izzy", "james": "jim jimmy jamie", "johannes": "hannes hans jo", "joseph": "joe joey", "katharine": "kate kathy katie kath", "leonard": "leo len lenny", "margaret": "peggy maggie meg", "maximilian": "max", "michael": "mike mick micky", "nicholas": "nick nicky", "oliver": "ollie olli olly", "patricia": "trish pat patty", "richard": "dick rick rich", "robert": "bob rob bobby", "rosalind": "roz ros", "samantha": "sam sammy", "susanne": "susi susie", "theodora": "thea teddy dora theo", "thomas": "tom tommy", "ursula": "uschi ulla", "victoria": "vicky vicki tori", "wilhelmina": "mina billie minnie", "william": "bill will billy", "yolanda": "yoli yola", "zoltán": "zoli",
    "anna": "", "daniel": "dan", "david": "dave", "edward": "ed ted", "helena": "lena", "julia": "", "laura": "", "martin": "", "paul": "", "peter": "pete", "simon": "", "sophie": "", "stephen": "steve", "matthew": "matt", "anthony": "tony", "charles": "charlie",
}
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme")
LEGAL = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "sa": "", "gmbh": "", "ag": "", "bv": "", "plc": "", "llc": ""}
BUSINESS = {"manufacturing": "mfg manuf", "technologies": "tech techn", "laboratories": "labs lab", "engineering": "eng engg", "logistics": "log logist", "services": "svcs serv svc", "instruments": "instr inst", "international": "intl int", "consulting": "cons consult", "transport": "transp trans", "fieldworks": "fwks", "systems": "sys", "industries": "ind", "partners": "", "foods": "", "energy": ""}
EMPTY = ("the", "group")

_GIVEN: dict[str, tuple[str, ...]] = {}
for _full, _short in SHORT_FORMS.items():
    for _w in (_full, *_short.split()):
        _GIVEN[_w] = (*_GIVEN.get(_w, ()), _full)
_LEGAL = {w: k for k, v in LEGAL.items() for w in (k, *v.split())}
_BUSINESS = {w: k for k, v in BUSINESS.items() for w in (k, *v.split())}
_TOKEN = re.compile(r"[^\W_]+")
#: Letters that a root has at least, and the distance allowed from LONG letters on.
ROOT_LEAST, LONG = 5, 8


def _close(w: str, words, least: int = 5) -> str | None:
    if len(w) < least:
        return None
    best = [x for x in words if len(x) >= least and abs(len(x) - len(w)) <= 1 and edits(w, x, 1) <= 1]
    return best[0] if len(best) == 1 else None


def _fold(name: str) -> list[tuple[str, bool]]:
    """Tokens with whether a full stop follows; dotted letters (s.a.) are one token."""
    s = re.sub(r"\b((?:[^\W\d_]\.){2,})", lambda m: m.group(1).replace(".", "") + " ", name)
    return [(m.group(), s[m.end() : m.end() + 1] == ".") for m in _TOKEN.finditer(s)]


def read_name(name: str, roots: frozenset[str] | None = None) -> dict:
    """Roles of the tokens of a lower-case spelling."""
    given, initials, legal, business, title, group, rest = [], [], "", "", "", False, []
    for w, dot in _fold(name):
        if w in EMPTY:
            group |= w == "group"
        elif w in TITLES:
            title = w
        elif w in _LEGAL:
            legal = _LEGAL[w]
        elif w in _BUSINESS:
            business = _BUSINESS[w]
        elif w in _GIVEN:
            given.append(w)
        elif len(w) == 1:
            initials.append(w)
        elif (x := _close(w, BUSINESS, 7)) or (x := _close(w, LEGAL, 6)):
            if x in BUSINESS:
                business = x
            else:
                legal = x
        elif dot and len(w) <= 5 and any(g.startswith(w) for g in SHORT_FORMS):
            given.append(w + ".")
        elif x := _close(w, SHORT_FORMS, 5):
            given.append(x)
        else:
            rest.append(w)
    glued = ""
    if len(rest) == 1 and not business:
        for b in BUSINESS:
            if rest[0].endswith(b) and len(rest[0]) - len(b) >= ROOT_LEAST:
                rest, business = [rest[0][: -len(b)]], b
                break
    if not rest and given and len(given) > 1:
        rest = [given.pop()]
    root = max(rest, key=len) if rest else ""
    other = " ".join(sorted(w for w in rest if w != root))
    firm = bool(legal or business or group)
    if len(rest) == 1 and not (given or initials or title or firm):
        glued = root[1:]  # perhaps an initial and the root run together
    kind = "org" if firm else "person" if given or initials or title else ""
    g = ""
    if given:
        w = given[0]
        fulls = _GIVEN.get(w, tuple(x for x in SHORT_FORMS if x.startswith(w.rstrip("."))) if w.endswith(".") else (w,))
        g = "|".join(sorted(fulls))
    return {"root": root, "other": other, "kind": kind, "given": g, "initial": initials[0] if initials else "", "business": business, "legal": legal, "glued": glued}


def token_cost(a: str, b: str) -> float:
    """0 for equal tokens, less than 1 for an initial, an abbreviation, a short form or a small edit, 1 otherwise."""
    if a == b:
        return 0.0
    s, t = sorted((a.rstrip("."), b.rstrip(".")), key=len)
    if s == t or set(_GIVEN.get(s, ())) & set(_GIVEN.get(t, ())) or (s in _LEGAL and _LEGAL[s] == _LEGAL.get(t)) or (s in _BUSINESS and _BUSINESS[s] == _BUSINESS.get(t)):
        return 0.1
    if t.startswith(s) and (len(s) == 1 or len(s) >= 3):
        return 0.2
    most = 1 if len(t) < LONG else 2
    d = edits(s, t, most)
    return 0.3 * d if d <= most and len(s) >= 4 else 1.0


def aligned(a: str, b: str) -> bool:
    """Whether the tokens of the shorter spelling can each be assigned to a token of the longer one below cost 1; titles, legal forms, "the" and "group" may stay alone."""
    x, y = ([w for w, _ in _fold(n) if w not in TITLES and w not in EMPTY] for n in (a, b))
    if len(x) > len(y):
        x, y = y, x
    free = {"ltd", *_LEGAL}
    price = lambda u, c: c if c < 1 else 0.5 if u in free else 1.0
    if x and assignment([[price(u, token_cost(u, v)) for v in y] for u in x]) < 1:
        return True
    # an initial run together with the family name, or the firm's name with its line of business
    j, k = ("".join(z) for z in (x, y))
    orders = permutations(y) if len(y) <= 3 else (y, y[::-1])
    return j == k or any(w == i + r for w in x for i in {v[0] for v in y} for r in y) or any(edits(j, z, 1) <= 1 for z in ("".join(p) for p in orders))


def assignment(cost: list[list[float]]) -> float:
    """Lowest total of one column for each row (rows not more than columns), by shortest augmenting paths over reduced costs."""
    rows, cols = len(cost), len(cost[0])
    owner: list[int | None] = [None] * cols
    u, v = [0.0] * rows, [0.0] * cols
    for start in range(rows):
        dist, via, done = [math.inf] * cols, [-1] * cols, [False] * cols
        row, last, base = start, -1, 0.0
        while True:  # grow the tree by its nearest column until one is free
            for c in range(cols):
                if not done[c] and (d := base + cost[row][c] - u[row] - v[c]) < dist[c]:
                    dist[c], via[c] = d, last
            last = min((c for c in range(cols) if not done[c]), key=dist.__getitem__)
            base, done[last] = dist[last], True
            if owner[last] is None:
                break
            row = owner[last]
        for c in range(cols):
            if done[c]:
                if owner[c] is not None:
                    u[owner[c]] += base - dist[c]
                v[c] -= base - dist[c]
        u[start] += base
        while last >= 0:
            owner[last] = owner[via[last]] if via[last] >= 0 else start
            last = via[last]
    return sum(cost[r][c] for c, r in enumerate(owner) if r is not None)


_ROLES = T.StructType([T.StructField(c, T.StringType()) for c in ("root", "other", "kind", "given", "initial", "business", "legal", "glued")])


@F.pandas_udf(_ROLES)
def read_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(x) for x in s], columns=[f.name for f in _ROLES.fields])


@F.pandas_udf(T.BooleanType())
def aligned_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([aligned(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletes_udf(s: pd.Series) -> pd.Series:
    return s.map(deletes)


@F.pandas_udf(T.ArrayType(T.StringType()))
def one_delete_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda w: deletes(w, 1))


@F.pandas_udf(T.IntegerType())
def edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def deletes(w: str, most: int = 2) -> list[str]:
    """What is left of a token after up to one deletion, or two (``most``) from LONG letters on."""
    out = {w}
    for _ in range(1 if len(w) < LONG else most):
        out |= {v[:i] + v[i + 1 :] for v in out for i in range(len(v))}
    return sorted(out)


def spellings(columns: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(name, n, off) from (table, name column, type column or None): rows with each spelling, and those typed as something that is neither person nor organisation."""
    out = None
    for df, c, t in columns:
        kind = F.lower(F.trim(F.col(t))) if t else F.lit(None).cast("string")
        one = df.select(F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")).alias("name"), kind.isin("concept", "product", "location").cast("int").alias("off"), kind.isin("person", "org", "organization", "organisation", "company").cast("int").alias("on")).where("name is not null and name <> ''")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.count("*").alias("n"), F.coalesce(F.sum("off"), F.lit(0)).alias("off"), F.coalesce(F.sum("on"), F.lit(0)).alias("on")).where("off <= on").select("name", "n")


def root_map(roots: DataFrame, signs: DataFrame) -> DataFrame:
    """(root, to): each root that is a misspelling, with the more frequent root that it is near to (itself otherwise). ``signs`` (root, sign) has the given names and lines of business that stand with a root."""
    more, side = "a <> b and (nb > na or (nb = na and b < a))", lambda k, x: k.select(F.col("root").alias(x), F.col("n").alias("n" + x), "k")
    key = roots.where(F.length("root") >= ROOT_LEAST).select("root", "n", F.explode(one_delete_udf("root")).alias("k"))
    # an edit with transpositions is at most two without; that bound is compiled code and decides most pairs
    one = side(key, "a").join(side(key, "b"), "k").where(more).select("a", "na", "b", "nb").distinct().where(F.levenshtein("a", "b", 2) >= 0).withColumn("d", edits_udf("a", "b")).where("d <= 1")
    same = one.select("a", "b").join(signs.toDF("a", "s"), "a").join(signs.toDF("b", "s"), ["b", "s"], "left_semi").select("a", "b").distinct().withColumn("same", F.lit(1))
    one = one.join(same, ["a", "b"], "left").groupBy("a").agg(F.max_by("b", F.struct(F.coalesce("same", F.lit(0)), "nb", "b")).alias("to"))
    one = materialize(one, "near")
    # two edits: keys are what is left together with a sign; a root without signs meets all
    ends = roots.where(F.length("root") >= LONG).join(one.select(F.col("a").alias("root")), "root", "left_anti").join(signs.groupBy("root").agg(F.collect_set("sign").alias("signs")), "root", "left")
    ends = ends.select("root", "n", "signs", F.explode(deletes_udf("root")).alias("k"))
    signed = lambda known, none: ends.withColumn("s", F.explode(F.when(F.col("signs").isNotNull(), F.array_append("signs", known)).otherwise(none))).withColumn("k", F.xxhash64("k", "s"))
    a, b = signed("-", F.array(F.lit("+"))), signed("+", F.array(F.lit("-"), F.lit("+")))
    two = side(a, "a").join(side(b, "b"), "k").where(more).select("a", "na", "b", "nb").distinct().where(F.levenshtein("a", "b", 4) >= 0).withColumn("d", edits_udf("a", "b")).where("d <= 2")
    to = materialize(one.unionByName(two.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("to"))), "near")
    # a misspelling of a misspelling leads to the root behind it; every round halves the way
    while True:
        on = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
        if to.join(on, "to", "left_semi").isEmpty():
            break
        to = materialize(to.join(on, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "near")
    return roots.select("root").distinct().join(to.withColumnRenamed("a", "root"), "root", "left").select("root", F.coalesce("to", "root").alias("to"))


def name_entities(columns: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(name, entity): each spelling of a person or organisation with the entity's most frequent spelling."""
    # written first: the filter on the roles would otherwise be pushed below the aggregate and read every row's name
    every = materialize(spellings(columns), "spellings")
    each = materialize(every.withColumn("r", read_udf("name")).select("name", "n", "r.*"), "names")
    read = each.where("root <> ''")
    whole = read.groupBy("root").agg(F.sum("n").alias("n"), F.max(F.when(F.col("kind") != "", 1).otherwise(0)).alias("sure"))
    # an initial run together with a family name that stands elsewhere
    parts = read.where("glued <> ''").select("name", "root", "glued").join(whole.where("sure = 1").select(F.col("root").alias("glued")), "glued").select("name", F.col("glued").alias("real"), F.substring("root", 1, 1).alias("first"))
    read = read.join(parts, "name", "left").select("name", "n", F.coalesce("real", "root").alias("root"), "other", F.when(F.col("real").isNotNull(), "person").otherwise(F.col("kind")).alias("kind"), "given", F.coalesce("first", "initial").alias("initial"), "business", "legal")
    signs = materialize(read.select("root", F.explode(F.expr("case when kind = 'person' and given <> '' then split(given, '[|]') when kind = 'org' and business <> '' then array(business) end")).alias("sign")).distinct(), "signs")
    roots = materialize(root_map(read.groupBy("root").agg(F.sum("n").alias("n")), signs), "roots")
    rows = materialize(read.join(roots, "root").drop("root").withColumnRenamed("to", "root"), "rooted")
    # entities: full spellings; a short form of two given names goes to the one that the root has
    person = rows.where("kind = 'person' and given <> ''").withColumn("g", F.explode(F.split("given", r"\|")))
    sure = person.where("given not like '%|%'").select("root", "g").distinct()
    person = person.join(sure.withColumn("known", F.lit(1)), ["root", "g"], "left")
    n_known = F.sum("known").over(Window.partitionBy("name"))
    person = person.withColumn("nk", n_known).where("nk is null or (nk = 1 and known = 1)")
    person = person.select("name", "n", "root", F.when(F.col("nk").isNull(), F.col("given")).otherwise(F.col("g")).alias("key"), F.lit("person").alias("kind")).distinct()
    firm = rows.where("kind = 'org' and (business <> '' or other <> '')").select("name", "n", "root", F.concat_ws("/", "business", "other").alias("key"), F.lit("org").alias("kind"), "legal")
    # firms of one name and line of business with different legal forms are different firms; without a form, the only one
    forms = firm.where("legal <> ''").groupBy("root", "key").agg(F.count_distinct("legal").alias("nf"), F.min("legal").alias("one"))
    firm = firm.join(forms, ["root", "key"], "left").select("name", "n", "root", F.concat_ws("/", "key", F.when(F.col("nf") == 1, F.col("one")).otherwise(F.col("legal"))).alias("key"), "kind")
    full = person.unionByName(firm)
    entity = materialize(full.groupBy("kind", "root", "key").agg(F.max_by("name", F.struct("n", "name")).alias("entity")), "entities")
    named = full.join(entity, ["kind", "root", "key"]).select("name", "entity")
    short = rows.join(named, "name", "left_anti").select("name", "root", "kind", "initial", "legal", "given")
    e = entity.select("root", F.col("kind").alias("ek"), "key", "entity")
    able = short.join(e, "root").where(
        "(kind = '' or kind = ek)"
        " and (initial = '' or ek = 'org' or exists(split(key, '[|]'), x -> startswith(x, initial)))"
        " and (legal = '' or ek = 'person' or element_at(split(key, '/'), -1) = legal or element_at(split(key, '/'), -1) not in ('limited','incorporated','corporation','company','sa','gmbh','ag','bv','plc','llc'))"
    )
    # with any full spelling of the entity: the most frequent may hold a short form, which an initial cannot be aligned with
    fulls = full.select("root", F.col("kind").alias("ek"), "key", F.col("name").alias("full")).distinct()
    fits = able.where("kind = ''").select("name", "entity").unionByName(able.where("kind <> ''").join(fulls, ["root", "ek", "key"]).where(aligned_udf("name", "full")).select("name", "entity").distinct())
    # a spelling that fits several entities stays alone
    only = fits.groupBy("name").agg(F.count("*").alias("c"), F.min("entity").alias("entity")).select("name", F.when(F.col("c") == 1, F.col("entity")).otherwise(F.col("name")).alias("entity"))
    left = short.join(fits.select("name").distinct(), "name", "left_anti")
    # spellings that fit no entity: alike among themselves by root, kind and what else they have
    key = ["root", "kind", "initial", "given", "legal"]
    alone = left.join(left.groupBy(*key).agg(F.min("name").alias("entity")), key).select("name", "entity")
    bare = each.where("root = ''").select("name", F.col("name").alias("entity"))
    return named.unionByName(only).unionByName(alone).unionByName(bare).groupBy("name").agg(F.min("entity").alias("entity"))
