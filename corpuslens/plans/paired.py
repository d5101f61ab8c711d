"""Plans over CONTENT: pairs of words by ``operators.pairs``. The SQL states what they compute, and runs where ids repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import content_words
from corpuslens.operators import pairs, scoring
from corpuslens.operators.graph import materialised

from .catalog import CONTENT, sql_of
from .catalog import PLANS as CATALOG
from .extra import PLANS as EXTRA
from .more import PLANS as MORE

PLANS = CATALOG | EXTRA | MORE


def content(spark: SparkSession, sf_dir: str) -> pairs.Content | None:
    """None if a document has no id of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pairs.Content(docs) if scoring.keyed(docs, "doc_id") else None


def _run(c: pairs.Content, name: str, sf_dir: str, **views: DataFrame) -> DataFrame:
    rest = sql_of(PLANS[name][len(CONTENT) :], "spark", sf_dir).lstrip()
    return c.docs.sparkSession.sql("with " + ", ".join(f"{v} as (select * from {{{v}}})" for v in views) + " " + rest, **views)


def _distinct(c: pairs.Content) -> DataFrame:
    return c.docs.select("doc_id", F.explode(F.array_distinct(content_words(F.col("text")))).alias("token"))


def _rare(c: pairs.Content) -> DataFrame:
    n, df = F.lit(c.documents), F.col("df")
    return c.counts.select("token", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))


def _ag6(c, sf_dir):
    return c.pairs(4).select("a", "b", "c")


def _ag8(c, sf_dir):
    share = F.col("c") * 1.0 * F.lit(c.windows) / (F.col("ax") * F.col("bx"))
    return c.pairs(3).select("a", "b", F.round(F.greatest(F.lit(0.0), F.log2(share)), 9).alias("ppmi"))


def _ag13(c, sf_dir):
    n = F.lit(c.windows)
    return c.pairs(3).select("a", "b", F.round((F.col("c") - F.col("ax") * F.col("bx") * 1.0 / n) / F.sqrt(F.col("ax") * 1.0 * F.col("bx") / n), 9).alias("z"))


def _ag10(c, sf_dir):
    met = pairs.counted(c.docs, c.words("df >= 4", "df"), 4, "rarest")
    pmi = F.log((F.lit(c.documents) * F.col("c") + 1.0) / (F.col("ax") * F.col("bx") + 1.0))
    e = met.select("a", "b", "c", pmi.alias("pmi")).where("pmi >= 3")
    both = e.select(F.explode(F.array(F.struct("a", "b", "c", "pmi"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "c", "pmi"))).alias("x")).select("x.*")
    return c.docs.sparkSession.sql("select a, b, c, round(pmi, 9) pmi from (select a, b, c, pmi, row_number() over (partition by a order by round(pmi, 9) desc, b) k from {both}) z where k <= 10", both=both)


def _ag26(c, sf_dir):
    rare = c.words(f"df >= 2 and df <= greatest(10, {0.02 * c.documents!r})", "df")
    met = pairs.counted(c.docs, rare, 2, "documents", lambda n, x, y: n <= 10)
    return met.select("a", "b", "c", F.round(F.lit(1.0) / F.col("c"), 9).alias("discrimination"))


def _ag28(c, sf_dir):
    share = F.col("c") * 1.0 / (F.col("ax") + F.col("bx") - F.col("c"))
    met = pairs.counted(c.docs, c.words("df >= 3", "df"), 2, "documents", lambda n, x, y: n * 1.0 / (x + y - n) >= 0.4 - 1e-9)  # of df 3 at least, 0.4 takes two meetings
    return met.where(share >= 0.4).select("a", "b", F.round(share, 9).alias("jaccard"))


def _j5(c, sf_dir):
    """Pairs with a word of one window meet once: they are the meetings that the other words' pairs leave."""
    met = materialised(pairs.counted(c.docs, c.words("wf >= 2"), 1, tallied=True).groupBy("c").agg(F.sum("pairs").alias("pairs")))
    meetings = (c.counts.agg(F.sum("met")).first()[0] or 0) // 2
    rest = meetings - (met.agg(F.sum(F.col("c") * F.col("pairs"))).first()[0] or 0)
    once = c.docs.sparkSession.createDataFrame([(1, rest)], "c bigint, pairs bigint").where("pairs > 0")
    return met.unionByName(once).groupBy("c").agg(F.sum("pairs").alias("pairs"))


def _g7(c, sf_dir):
    met = c.pairs(3)
    e = met.select(F.explode(F.array("a", "b")).alias("token"), "c")
    return e.groupBy("token").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("c").alias("strength"), F.max("c").alias("strongest"))


def _tp19(c, sf_dir):
    """A word's strength, the sum of its pairs' counts, is the number of words that it meets in its windows."""
    table = c.counts.where("met > 0").select("token", F.col("met").alias("wf"), "df").toArrow()
    return pairs.strongest(c.docs, pairs.Words(table, "wf", "ascending"), 5)


def _ag21(c, sf_dir):
    return _run(c, "ag21_neighbour_cosine", sf_dir, rare=_rare(c), pairs=c.pairs(3, f"ln(1 + ({c.documents} - df + 0.5) / (df + 0.5)) >= 3.5 - 1e-9"))


def _r29(c, sf_dir):
    scarce = f"df between 4 and greatest(10, {0.02 * c.documents!r})"
    nd = c.docs.sparkSession.createDataFrame([(c.documents,)], "n bigint")
    return _run(c, "r29_rare_correlations", sf_dir, df=c.counts.select("token", "df"), nd=nd, dw=_distinct(c), pairs=materialised(c.pairs(4, scarce)))


def _r46(c, sf_dir):
    return _run(c, "r46_shell_maxsim", sf_dir, links=materialised(c.links()), wf=c.counts.select("token", F.col("wf").alias("df")), dw=_distinct(c), rare=_rare(c))


STEPS: dict[str, Callable[[pairs.Content, str], DataFrame]] = {
    "ag6_cooccurrence": _ag6,
    "ag8_ppmi": _ag8,
    "ag10_pmi_graph": _ag10,
    "ag13_z_cohesion": _ag13,
    "ag21_neighbour_cosine": _ag21,
    "ag26_heavy_anchors": _ag26,
    "ag28_set_bridges": _ag28,
    "j5_pair_counts": _j5,
    "g7_knowledge_graph": _g7,
    "tp19_hub_signatures": _tp19,
    "r29_rare_correlations": _r29,
    "r46_shell_maxsim": _r46,
}


def paired(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = content(spark, sf_dir)
        return spark.sql(sql_of(PLANS[name], "spark", sf_dir)) if c is None else STEPS[name](c, sf_dir)

    return query
