"""Model replies: parsing, gleaning, keyword merging, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import strip, strip_fence

REPLY = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,keywords:string,description:string>>,keywords:array<string>,summary:string>"


def parse_reply(c: Column) -> Column:
    """A reply in or out of a code fence; broken JSON gives an empty result."""
    r = F.from_json(strip_fence(c), REPLY)
    ents = F.coalesce(r["entities"], F.array().cast("array<struct<name:string,type:string,description:string>>"))
    ents = F.filter(F.transform(ents, lambda e: F.struct(strip(F.coalesce(e["name"], F.lit(""))).alias("name"), F.coalesce(F.nullif(F.lower(strip(e["type"])), F.lit("")), F.lit("other")).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"))), lambda e: e["name"] != "")
    rels = F.coalesce(r["relationships"], F.array().cast("array<struct<source:string,target:string,keywords:string,description:string>>"))
    rels = F.transform(rels, lambda e: F.struct(*[strip(F.coalesce(e[k], F.lit(""))).alias(k) for k in ("source", "target", "keywords", "description")]))
    rels = F.filter(rels, lambda e: (e["source"] != "") & (e["target"] != "") & (F.lower(e["source"]) != F.lower(e["target"])))
    return F.struct(ents.alias("entities"), rels.alias("relationships"), F.coalesce(r["keywords"], F.array().cast("array<string>")).alias("keywords"), F.coalesce(r["summary"], F.lit("")).alias("summary"))


def valid_relations(rel: DataFrame) -> DataFrame:
    """Rows with two different non-blank ends."""
    a, b = strip(F.coalesce("source", F.lit(""))), strip(F.coalesce("target", F.lit("")))
    return rel.where((a != "") & (b != "") & (F.lower(a) != F.lower(b)))


def merge_keywords(base: Column, extra: Column) -> Column:
    """``extra`` keywords that are not there yet, letter case and outer blanks ignored, are added in order."""
    zero = F.coalesce(base, F.array().cast("array<string>"))
    return F.aggregate(F.coalesce(extra, F.array().cast("array<string>")), zero, lambda a, k: F.when((strip(k) == "") | F.exists(a, lambda x: F.lower(strip(x)) == F.lower(strip(k))), a).otherwise(F.concat(a, F.array(strip(k)))))


def glean_entities(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Entities of a second extraction whose name is new for the chunk are added; the base comes first."""
    u = base.withColumn("turn", F.lit(0)).unionByName(extra.withColumn("turn", F.lit(1)))
    key = F.lower(strip(F.col("name")))
    return u.withColumn("k", key).groupBy("chunk_id", "k").agg(F.min_by(F.struct("name", "turn", "ordinal"), F.struct("turn", "ordinal", "name")).alias("v")).select("chunk_id", "k", "v.name", "v.turn")


def glean_reply(base: Column, extra: Column) -> Column:
    """A parsed reply with a second one's entities of new names and relations of new pairs of ends, either direction."""
    low = lambda x, k: F.lower(x[k])
    ents = F.aggregate(extra["entities"], base["entities"], lambda a, e: F.when(F.exists(a, lambda x: low(x, "name") == low(e, "name")), a).otherwise(F.concat(a, F.array(e))))
    same = lambda x, e: ((low(x, "source") == low(e, "source")) & (low(x, "target") == low(e, "target"))) | ((low(x, "source") == low(e, "target")) & (low(x, "target") == low(e, "source")))
    rels = F.aggregate(extra["relationships"], base["relationships"], lambda a, e: F.when(F.exists(a, lambda x: same(x, e)), a).otherwise(F.concat(a, F.array(e))))
    return F.struct(ents.alias("entities"), rels.alias("relationships"), base["keywords"].alias("keywords"), base["summary"].alias("summary"))


def batch_windows(chunks: DataFrame, n: int = 5) -> DataFrame:
    """Batches of ``n`` chunks in sequence, for prompts that see several."""
    return chunks.withColumn("batch", F.floor(F.col("sequence_index") / n).cast("int"))


def split_batch_reply(c: Column, n: int) -> Column:
    """Parts of a reply that are not blank, divided by every ---, padded or cut to ``n``."""
    parts = F.filter(F.transform(F.split(c, "---"), strip), lambda x: x != "")
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def embedding_text(text: Column, keywords: Column) -> Column:
    has = F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0
    return F.when(has, F.concat(text, F.lit("\n\nContextual keywords: "), F.array_join(keywords, ", "))).otherwise(text)
