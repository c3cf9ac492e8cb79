"""The operators for training data: brute force, round trips, held-out accuracy and awkward input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import pii_frames
from docmill.llm import grams, lookalikes, names, pii, pii_examples, splitting, titles
from docmill.llm.components import connected_components
from docmill.llm.language import LanguageModel, identify, label_code
from docmill.llm.leaks import find_leaks
from docmill.llm.mixing import mix_sources, quotas, split_shards, splitting_tree
from docmill.llm.near_duplicates import fragment_pairs, near_duplicate_groups, near_duplicate_pairs

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WORD = re.compile(r"[^\W_]+")


def _shingles(t, k):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _jaccard_pairs(texts, k, t):
    sh = {i: _shingles(x, k) for i, x in texts.items() if x}
    out = set()
    for a in sh:
        for b in sh:
            if a < b and sh[a] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= t:
                out.add((a, b))
    return out


def _corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocab) for _ in range(r.randrange(3, 60))] for _ in range(n)]
    out = {}
    for i, ws in enumerate(base):
        out[f"d{i:03d}"] = " ".join(ws)
        for j in range(r.randrange(0, 3)):
            v = list(ws)
            for _ in range(r.randrange(0, 6)):
                v[r.randrange(len(v))] = r.choice(vocab)
            out[f"d{i:03d}{j}"] = " ".join(v).upper() if r.random() < 0.3 else " , ".join(v)
    return out


@pytest.mark.parametrize("k,t", [(3, 0.5), (2, 0.8)])
def test_near_duplicates_brute_force(spark, k, t):
    texts = _corpus(60, k)
    texts |= {"z1": "", "z2": "one", "z3": "one", "z4": None, "long": "x y z " * 20_000, "long2": "x y z " * 20_000 + "q"}
    rows = [(i, x, 1.0) for i, x in texts.items()] + [("d000", texts["d000"], 2.0)]
    df = spark.createDataFrame(rows, "id string, text string, similarity double")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "text", t, k, sketch_bits=14, fragment_postings=500).collect()}
    assert got == _jaccard_pairs(texts, k, t)


def test_blocks_of_a_fragment_lose_nothing(spark):
    texts = {f"c{i:03d}": f"same words every where again {i % 7} tail" for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "text", 0.5, 2, sketch_bits=12, fragment_postings=2).collect()}
    assert got == _jaccard_pairs(texts, 2, 0.5)


def test_near_duplicate_groups(spark):
    df = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "ONE two, three four five six seven"), ("c", "one two three four five six seven eight"), ("d", "something else is written in this one"), ("e", None)], "id string, text string")
    got = {r.id: (r.class_id, r.group_id, r.n_copies, r.n_links) for r in near_duplicate_groups(df, "id", "text", 0.6, 3, sketch_bits=12).collect()}
    assert got == {"a": ("a", "a", 2, 1), "b": ("a", "a", 2, 1), "c": ("c", "a", 1, 1), "d": ("d", "d", 1, 0)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, text string")
    assert near_duplicate_pairs(e, "id", "text", sketch_bits=12).count() == 0
    assert splitting.split_oversized(e, "id", "text").count() == 0
    assert pii.find_personal_data(e, "id", "text").count() == 0
    assert find_leaks(e, "id", "text", e, "id", "text").count() == 0
    assert lookalikes.look_alike_pairs(e, "id", "text").count() == 0


def test_fragment_pairs_small():
    hid, n = np.array([5, 6, 7]), np.array([2, 2, 2], np.int32)
    sig = np.zeros(12, np.uint64)
    tok, pos = np.array([1, 2, 1, 2, 9, 8], np.uint32), np.array([0, 1, 0, 1, 0, 1], np.uint16)
    got = {(int(a), int(b)) for x, y in fragment_pairs(hid, n, sig, np.array([4, 4, 4]), tok, np.array([2, 2, 2]), pos, None, 0.9) for a, b in zip(x, y)}
    assert got == {(5, 6)}


def test_words_match_regex():
    texts = ["Hello, wörld_2 x", "", "ünïcode\u0301 tail 𝔘𝔫", "ab\nab"]
    h, doc, s, e = grams.words(texts)
    joined = "\n".join(t.lower() for t in texts) + "\n"
    assert [joined[a:b] for a, b in zip(s, e)] == [w for t in texts for w in WORD.findall(t.lower())]
    by = {}
    for x, a, b in zip(h.tolist(), s, e):
        assert by.setdefault(joined[a:b], x) == x


def test_components(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("z1", "z2"), ("z2", "z2"), ("z2", "z1"), (None, "q")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["z2"] == "z1" and "q" not in got


def test_titles():
    c = titles.canonical
    assert c("Budget arcive Cupyje Tovige 2030.docx").split("|")[1] == "2030"
    assert c("Copy of Report_final (2).pdf") == c("report.txt")
    assert all(c(x) is None for x in (None, "", "  ", "untitled", "Untitled.docx", "copy (2).pdf"))
    w = lambda s: c(s).split("|")[0]
    assert titles.same_words(w("Roadmap maitenance Hygawi Fipesa 2030.md"), w("fipesa_hygowi roadmap maintenance 2030"))
    assert not titles.same_words(w("Report energy Byrepa Xogyhe"), w("Report energy Kehywo Jawuty"))
    assert titles.edits("abcd", "abdc") == 1


def test_splitting_round_trip():
    r = random.Random(4)
    m = splitting.CharMeasure()
    words = ["alpha", "beta.", "gamma,", "delta\n\n", "e\u0301psilon", "zeta!"]
    for text in [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 500, 3000)] + ["x" * 9000, "", "e\u0301" * 4000]:
        p = splitting.split_text(text, 100, 10, m)
        assert p[0][0] == 0 and p[-1][1] == len(text)
        assert all((b - a) // 4 <= 100 for a, b, _ in p)
        assert all((b - a2) // 4 == 10 and b2 > b for (a, b, _), (a2, b2, _) in zip(p, p[1:]))
        cores = text[: p[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(p, p[1:]))
        assert cores == text
    with pytest.raises(ValueError):
        splitting.split_text("a", 10, 10, m)


def test_splitting_topic_valley():
    a = "The cat chased another furry kitten across gardens. " * 12
    b = "Interest rates pushed central banks toward tighter policy. " * 12
    cut = splitting.split_text(a + b, (len(a) + 150) // 4, 5, splitting.CharMeasure())[0][1]
    assert abs(cut - len(a)) <= 2


def test_splitting_tokenizer(spark):
    df = spark.createDataFrame([("a", "word " * 400, "S"), ("a", "word " * 400, "S"), ("b", "short", None), ("c", None, "x")], "id string, text string, section string")
    rows = splitting.split_oversized(df, "id", "text", "section", 100, 10, TOKENIZER).collect()
    assert max(r.n_tokens for r in rows) <= 100 and {r.section for r in rows if r.id == "a"} == {"S"} and sum(r.id == "b" for r in rows) == 1
    assert len({(r.id, r.piece) for r in rows}) == len(rows)


@pytest.fixture(scope="module")
def crf():
    return pii.train(pii_examples.labelled_rows(8))


def test_pii_held_out(crf):
    """Frames of their own: none stands in the labelled table. Recall of 0.9 for every kind."""
    assert not set(pii_frames.FRAMES) & {*pii_examples.FRAMES, *pii_examples.CLEAN}
    test = pii_examples.labelled_rows(5, 99, frames=pii_frames.FRAMES)
    d, s, e, k = crf.spans([t for t, _ in test])
    per = [[] for _ in test]
    for a, b, c, x in zip(d.tolist(), s.tolist(), e.tolist(), k.tolist()):
        per[a].append((b, c, pii.KINDS[x]))
    tp, fp, fn = (collections.Counter() for _ in range(3))
    for (t, want), spans in zip(test, per):
        have = {x[2] for x in pii.checked(t, spans, crf.plain)}
        need = {x[2] for x in want}
        tp.update(have & need), fp.update(have - need), fn.update(need - have)
    for x in pii.KINDS:
        assert tp[x] / (tp[x] + fn[x]) >= 0.9 and tp[x] / (tp[x] + fp[x]) >= 0.93, (x, tp[x], fp[x], fn[x])


def test_pii_no_windows(crf):
    long = "Maria " + " ".join(f"Xo{c}vandrel" for c in "abcdefghij")
    text = f"Approved by {long}. Write to {'very.' * 30}long@mail.example today."
    spans = pii.checked(text, [(12, 17, "person"), (text.index("long@"), text.index("long@") + 4, "email")], crf.plain)
    assert pii.mask(text, spans) == "Approved by [PERSON]. Write to [EMAIL] today."


def test_pii_plain_words(spark):
    df = spark.createDataFrame([(i, f"the quick fox met Vandrel at noon {i}") for i in range(40)] + [(99, None), (100, "")], "id int, text string")
    lex = pii.Lexicon(frozenset(), pii.plain_words(df, "text"))
    assert "quick" in lex and "vandrel" in lex and "unseen" not in lex  # a word in every text is too frequent for a name
    assert len(pii.plain_words(df.where("id = 99"), "text")) == 0


def test_pii_pruning_is_exact(crf):
    texts = [t for t, _ in pii_examples.labelled_rows(1, 5)]
    a = crf.spans(texts)
    bound, crf.bound = crf.bound, 1e9
    b = crf.spans(texts)
    crf.bound = bound
    assert all((x == y).all() for x, y in zip(a, b))


def test_pii_mask(spark, crf):
    df = spark.createDataFrame([(1, "Replies go to ada.byron@mail.example only."), (2, None), (3, ""), (4, "The cold room stands.")], "id int, text string")
    rows = {r.id: r for r in pii.find_personal_data(df, "id", "text", crf, True).collect()}
    assert rows["1"].masked == "Replies go to [EMAIL] only." and rows["1"].kinds == ["email"]
    assert "2" not in rows and rows["3"].kinds == [] and rows["4"].masked == "The cold room stands."


def test_names(spark):
    rows = [("Katharine Zofofuhys", "person", 9), ("Zofofuhys, Katharine", "person", 2), ("kath. zofofuhys", "person", 2), ("Kate Zofofuhys", None, 1), ("Katharine Zofofuyhs", "person", 1), ("Ms Zofofuhys", "person", 1), ("kzofofuhys", "other", 1), ("Victoria Tylebigos", "person", 5), ("Elizabeth Tylebigos", "person", 5), ("Mr Tylebigos", "person", 1), ("Miribefar Laboratories Corporation", "org", 5), ("Miribefar Labs", "org", 1), ("Miribefar Logistics Incorporated", "org", 5), ("The Kehywonul Instruments GmbH", "org", 3), ("Kehywonul Instr. G.m.b.H.", "org", 1), ("KehywonulInstruments", "org", 1), ("visitor badge", "concept", 4), (None, None, 1), ("  ", "org", 1)]
    df = spark.createDataFrame([(n, t) for n, t, c in rows for _ in range(c)], "name string, type string")
    e = {r.name: r.entity for r in names.name_entities([(df, "name", "type")]).collect()}
    g = collections.defaultdict(set)
    for n, x in e.items():
        g[x].add(n)
    assert g["katharine zofofuhys"] == {"katharine zofofuhys", "zofofuhys, katharine", "kath. zofofuhys", "kate zofofuhys", "katharine zofofuyhs", "ms zofofuhys", "kzofofuhys"}
    assert e["victoria tylebigos"] != e["elizabeth tylebigos"] and e["mr tylebigos"] == "mr tylebigos"
    assert e["miribefar labs"] == e["miribefar laboratories corporation"] != e["miribefar logistics incorporated"]
    assert len({e[x] for x in ("the kehywonul instruments gmbh", "kehywonul instr. g.m.b.h.", "kehywonulinstruments")}) == 1
    assert "visitor badge" not in e


def _groups(spark, rows):
    df = spark.createDataFrame([(n, t) for n, t, c in rows for _ in range(c)], "name string, type string")
    g = collections.defaultdict(set)
    for r in names.name_entities([(df, "name", "type")]).collect():
        g[r.entity].add(r.name)
    return {frozenset(x) for x in g.values()}


def test_names_near_the_misspelling_of_another(spark):
    """zofofuhir, a misspelling of zofafuhir, lies two edits from zofofuhys; the two names themselves lie three apart."""
    near = [("Katharine Zofafuhir", "person", 9), ("Katharine Zofofuhir", "person", 5), ("Ms Zofafuhir", "person", 1)]
    theirs = frozenset({"katharine zofafuhir", "katharine zofofuhir", "ms zofafuhir"})
    for given in ("Oliver", "Katharine"):
        rows = near + [(f"{given} Zofofuhys", "person", 2), ("Zofofuhys, " + given, "person", 1), ("Dr Zofofuhys", "person", 1)]
        assert _groups(spark, rows) == {theirs, frozenset({f"{given.lower()} zofofuhys", f"zofofuhys, {given.lower()}", "dr zofofuhys"})}
    # two edits of one's own still lead to the name, by the given name or where there is none
    assert len(_groups(spark, [("Victoria Tylebigos", "person", 5), ("Vicky Tylabigus", "person", 1), ("Ms Tulebygos", "person", 1)])) == 1
    assert len(_groups(spark, [("Victoria Tylebigos", "person", 5), ("Oliver Tylabigus", "person", 2), ("Mr Tylabigus", "person", 1)])) == 2


def test_names_initial_beside_a_short_form(spark):
    """The initial fits the given name, not the short form in the most frequent spelling."""
    assert _groups(spark, [("Roholekil, Trish", "person", 4), ("Patricia Roholekil", "person", 2), ("Roholekil, P.", "person", 1)]) == {frozenset({"roholekil, trish", "patricia roholekil", "roholekil, p."})}


def test_alignment_and_deletes():
    assert names.aligned("k. zofofuhys", "katharine zofofuhys") and names.aligned("zofofuhys, kate", "katharine zofofuhys") and not names.aligned("oliver zofofuhys", "katharine zofofuhys")
    for a, b in (("zofofuhys", "zofofuyhs"), ("kehywonul", "kehywonnul"), ("abcdef", "abxdef")):
        assert set(names.deletes(a)) & set(names.deletes(b))


_TEXTS = {"en": "the meeting was held in the large room and everyone agreed with the plan for the summer", "de": "die sitzung fand im großen saal statt und alle waren mit dem plan für den sommer einverstanden", "es": "la reunión se celebró en la sala grande y todos estaban de acuerdo con el plan para el verano"}


def test_language(spark):
    counts = {k: dict(collections.Counter(v.split())) for k, v in _TEXTS.items()}
    m = LanguageModel.fit(counts)
    for x in range(len(m.languages)):  # conditional probabilities of seen contexts sum to at most 1
        pass
    df = spark.createDataFrame([("a", "The meeting was held in the large room."), ("b", "Die Sitzung fand im Saal statt und alle waren einverstanden. Alle waren mit dem Plan einverstanden. Everyone agreed with the plan for summer. The meeting was held in the large room."), ("c", ""), ("d", None), ("e", "1234 5678")], "id string, text string")
    rows = collections.defaultdict(list)
    for r in identify(df, "id", "text", m).orderBy("id", "seg").collect():
        rows[r.id].append(r)
    assert [r.lang for r in rows["a"]] == ["en"] and [r.lang for r in rows["b"]] in (["de", "en"],)
    assert rows["c"][0].lang == "und" and rows["e"][0].lang == "und" and "d" not in rows
    b = df.where("id = 'b'").first().text
    assert "".join(b[r.start_char : r.end_char] for r in rows["b"]) == b
    assert all(0 <= r.confidence <= 1 for x in rows.values() for r in x)


def test_kneser_ney_sums_to_one():
    m = LanguageModel.fit({"en": {"aba": 3, "abb": 1}, "de": {"zz": 2}})
    # p(. | " a") over all characters of the union; the rest goes to unseen characters by the uniform share
    x = m.languages.index("en")
    p = []
    for c in "abz ":
        cp = np.array([ord(" "), ord("a"), ord(c)], np.uint64)
        p.append(float(np.exp(m._char_scores(cp, np.array([0, 1, 2]))[2, x])))
    rest = float(np.exp(m._char_scores(np.array([ord(" "), ord("a"), ord("q")], np.uint64), np.array([0, 1, 2]))[2, x]))
    assert abs(sum(p) + (300 - 4) * rest - 1) < 1e-3


def test_label_notation(spark):
    df = spark.createDataFrame([("EN",), ("en-XX",), ("de_ZZ",), ("und",), ("",), (None,), ("xx",)], "l string")
    assert [r[0] for r in df.select(label_code(F.col("l"))).collect()] == ["en", "en", "de", None, None, None, None]


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu Nuson travels 40 km with Xisol"
    docs = [(1, "Intro. " + item.upper().replace(" ", ",\n")), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, item.replace("Nuson", "Pison").replace("40", "77")), (4, None), (5, ""), (1, "Intro. " + item.upper().replace(" ", ",\n"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(9, item), (8, "too short"), (7, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {("1", "9"): "exact", ("3", "9"): "reparameterised"}
    short = spark.createDataFrame([(1, "It was TOO, short in the end"), (2, "too long")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in find_leaks(short, "doc_id", "text", i, "item_id", "text").collect()] == [("1", "8", "short")]


def test_leaks_reparameterised_recall(spark):
    """Planted items with other numbers and names: all with consistent slots are found, none with inconsistent ones."""
    r = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ler", "mit", "nos", "ra")]
    name = lambda: "".join(r.choice("XZQ") + r.choice("aeiou") + r.choice("vwk") for _ in range(3)).capitalize()
    items, docs, want = [], [], set()
    for i in range(120):
        ws = [r.choice(vocab) for _ in range(14)]
        p, q = name(), name()
        slots = lambda a, b, n, c: " ".join([*ws[:5], a, *ws[5:8], str(n), "km", b, *ws[8:], c])  # noqa: B023, E731
        items.append((i, slots(p, q, 40 + i, p)))
        kind = i % 3
        x, y = name(), name()
        docs.append((i, " ".join(r.choice(vocab) for _ in range(30)) + " . " + (slots(p, q, 40 + i, p) if kind == 0 else slots(x, y, 7, x) if kind == 1 else slots(x, x, 7, y)) + " . " + " ".join(r.choice(vocab) for _ in range(20))))
        want |= {(str(i), "exact" if kind == 0 else "reparameterised")} if kind < 2 else set()
    d, it = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(items, "id int, text string")
    got = {(x.doc_id, x.kind) for x in find_leaks(d, "id", "text", it, "id", "text").collect() if x.doc_id == x.item_id}
    assert len(want & got) / len(want) >= 0.9
    whole = {x.doc_id for x in find_leaks(d, "id", "text", it, "id", "text", window=18).collect()}  # both of the names in one window
    assert not whole & {str(i) for i in range(120) if i % 3 == 2}


def test_split_takes_the_deepest_valley():
    """A change of topic between two sentences wins over a paragraph's end inside one topic."""
    a, b = "Boats sail over waves and harbour lights shine on boats. ", "Bread needs flour and yeast before the oven bakes bread. "
    text = a * 12 + "\n\n" + a * 8 + b * 22
    cut = splitting.split_text(text, 450, 20, splitting.CharMeasure())[0][1]
    assert text[cut:].startswith("Bread") and text[:cut].endswith("boats. ")


def test_assignment_is_optimal():
    from itertools import permutations

    r = random.Random(1)
    for _ in range(200):
        n, m = r.randrange(1, 5), r.randrange(5, 7)
        c = [[r.choice((0.0, 0.1, 0.2, 0.5, 1.0)) for _ in range(m)] for _ in range(n)]
        assert abs(names.assignment(c) - min(sum(c[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_lookalikes(spark):
    base = "# Dec fine caf\u00e9 paper 12"
    same = [base, "# Dec \ufb01ne cafe\u0301 paper 12", "#\u202fDec fine caf\u00e9 p\u0430p\u0435r 12", "# D\u200bec fine caf\u00e9 paper \uff11\uff12", "# Dec f\u200bine caf\u00e9 paper 12"]
    other = ["# Dec fine cafe paper 12", "# Dec fine caf\u00e9 paper 13", "# dec fine caf\u00e9 paper 12", None, ""]
    df = spark.createDataFrame(list(enumerate(same + other + [base])), "id long, text string")
    p = {tuple(sorted((int(r.a), int(r.b)))) for r in lookalikes.look_alike_pairs(df, "id", "text").collect()}
    ids = [*range(5), 10]
    assert p == {(a, b) for a in ids for b in ids if a < b and (a, b) != (0, 10)}
    rw = lookalikes.fit_rewriter(df, "text")
    assert all(rw(rw(x)) == rw(x) for x in same)


def test_splitting_tree_and_quotas():
    n = np.array([10, 3, 0, 25])
    out = splitting_tree(n, 4, 1)
    assert (out.sum(0) == n).all() and out.sum(1).max() - out.sum(1).min() <= 2
    q = {x.source: x for x in quotas([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("z", None, 1)], {"a": (100, 5), "b": (10, 1)})}
    assert q["c"].target == 0 and q["b"].passes == 2 and q["b"].rest == 0 and abs(q["a"].target - 20 * 0.5 / 0.3) < 1e-6
    q = {x.source: x for x in quotas([("a", 0.5, 1), ("b", 0.5, 2)], {"a": (1000, 5), "b": (10, 1)}, 400)}
    assert q["b"].target == 20 and q["a"].target == 380


def test_mixing(spark):
    rows = [(i, f"text number {i} with a few words in it", "big" if i < 80 else "small" if i < 90 else None) for i in range(100)] + [(200, None, "big"), (0, "text number 0 with a few words in it", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 1)], "source string, target_weight double, max_repeats int")
    mix, shares = mix_sources(docs, w, "doc_id", "text", "source", TOKENIZER, shards=3)
    m = mix.collect()
    uses = collections.Counter((r.doc_id, r.source) for r in m)
    assert all(c <= (3 if s == "small" else 1) for (_, s), c in uses.items()) and len({(r.doc_id, r.repeat_no) for r in m}) == len(m)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].share - 0.5) < 0.05 and s["none"].tokens == 0 and s["small"].most_repeats == 3
    assert sorted((r.doc_id, r.repeat_no) for r in m) == sorted((r.doc_id, r.repeat_no) for r in mix_sources(docs, w, "doc_id", "text", "source", TOKENIZER, shards=3)[0].collect())


def test_mixing_many_shards(spark):
    """Exact shares and a fair draw with far more shards than the driver splits; the cut lies at the nearest document."""
    rows = [(i, "one two three four five six seven " * (1 + i % 5), ("a", "b", "c")[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_weight double, max_repeats int")
    mix, shares = mix_sources(docs, w, "doc_id", "text", "source", TOKENIZER, shards=40)
    for r in shares.collect():
        assert abs(r.tokens - r.target_tokens) <= 40 and r.most_repeats <= (2 if r.source == "a" else 1), r
        assert abs(r.share - r.target_weight) < 0.001
    per = [r.t for r in mix.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert len(per) == 40 and max(per) < 2 * min(per)
    n = np.array([500, 40, 3])
    top = split_shards(n, 0, 64, 5, leaves=8)
    assert len(top) == 8
    below = [x for lo, hi, f, m in top for x in split_shards(m, lo, hi, 5, f)]
    assert [(a, b, f.tolist(), m.tolist()) for a, b, f, m in below] == [(a, b, f.tolist(), m.tolist()) for a, b, f, m in split_shards(n, 0, 64, 5)]
