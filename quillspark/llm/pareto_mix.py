"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source has a target number of words. A source whose target is ``r`` times
its size first gets ``floor(r)`` whole copies of every document. The remaining
fraction ``f`` is filled by Pareto order sampling: a document of size ``s`` has
inclusion probability ``p`` proportional to ``s ** exponent`` (so that the
expected words are ``f`` times the source), a uniform ``u`` from a hash, and the
rank ``q = (u / (1 - u)) / (p / (1 - p))``. Documents are taken in the order of
``q`` up to the fixed total size, counted in words, that comes nearest to the
rest of the target. Documents with ``p >= 1`` come first.

Scale: the order is cut without sorting a source. Ranks fall into bins, the
bins' words (a partial aggregate of at most ``bins`` rows a source) say which
bin holds the cut, and only that bin's distinct documents are sorted. Only the key, the source
and the size of a document are read or shuffled, never its text. The list of
sources (one small row each) is ordered in one task.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null source
is a source of its own, last in order; repeated rows are separate documents with equal
ranks, of which as many are taken as the target needs (which of them, the reading task decides; they are equal); an empty table gives an empty result. If no source has a word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_RE, columns_of, written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEAT = 2
EXPONENT = 0.25
BINS = 4096
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of (source, source_size) rows: weights by code point order, repeating, null last.

    A target never exceeds ``max_repeat`` times the source's size. What is cut is shared again
    by weight. The fixed point is reached in closed form: sources in the order of
    ``max_repeat * size / weight`` are capped as long as the level that the others
    would get is above their cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                  (nth % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    whole = W.partitionBy()
    by_level = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("want", F.sum("source_size").over(whole).cast("double") * share_percent / 100)
    s = s.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    # the level rises while sources are capped and falls behind the first open one: its maximum is the fixed point
    s = s.withColumn("level", F.max("level").over(whole))
    first_open = F.min(F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(whole)
    s = s.withColumn("target", F.when(first_open.isNotNull() & (F.col("cap") / F.col("weight") >= first_open),
                                      F.col("level") * F.col("weight")).otherwise(F.col("cap")))
    return s.select("source", "source_size", "target")


def ranked(docs: DataFrame, targets: DataFrame, seed: str = SEED, exponent: float = EXPONENT,
           bins: int = BINS) -> DataFrame:
    """Adds copies, fraction words and the Pareto rank ``q`` to sized rows (source, size, key)."""
    power = F.floor(F.pow(F.col("size").cast("double"), F.lit(1 + exponent)) * 1000).cast("decimal(38,0)")
    scale = docs.groupBy(F.col("source").alias("m_source")).agg(
        F.try_divide(F.sum(power).cast("double") / 1000, F.sum("size")).alias("mean_power"))
    t = (targets.join(scale, F.col("source").eqNullSafe(F.col("m_source")), "left")
         .select(F.col("source").alias("t_source"), "source_size", "target", "mean_power",
                 F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
                 .cast("long").alias("whole")))
    # one row a source: tiny beside the documents; the join strategy is left to the measured size
    d = docs.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    d = d.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    hexa = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("key"))), 1, 8)
    u = (F.conv(hexa, 16, 10).cast("double") + 0.5) / 4294967296.0
    p = F.try_divide(F.try_divide(F.col("rest"), F.col("source_size")) * F.pow(F.col("size").cast("double"), F.lit(exponent)),
                     F.col("mean_power"))
    d = d.withColumn("u", u).withColumn("p", p)
    q = (F.when((F.col("size") <= 0) | (F.col("rest") <= 0), F.lit(None).cast("double"))
         .when(F.col("p") >= 1, F.lit(0.0))
         .otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("p"), 1 - F.col("p")))))
    d = d.withColumn("q", q)
    # p >= 1 all have q = 0: spread over bins below 0 by u, so that no bin is crowded
    bin_ = F.when(F.col("q") == 0, F.floor(F.col("u") * bins) - bins).otherwise(
        F.floor(F.col("q") / (1 + F.col("q")) * bins))
    return d.withColumn("bin", bin_.cast("long")).drop("p")


def first_of_equal(rows: DataFrame, groups: DataFrame, out: str, order: str = "key") -> DataFrame:
    """Adds ``out``: 1 for ``g_extra`` of the ``g_n`` rows of a ``key``, 0 for the others, by ``groups`` (g_key, g_n, g_extra).

    Only groups of which some rows are taken and some not are numbered: by ``part``, the task that read a row, with offsets from the
    counts of the parts, so that no task holds more of a group than it read; within a part they are taken in the order of ``order``. ``rows`` must be a written table.
    """
    rows = rows.join(groups, F.col("key") == F.col("g_key")).drop("g_key")
    split = (F.col("g_extra") > 0) & (F.col("g_extra") < F.col("g_n"))
    whole = rows.where(~split).withColumn(out, (F.col("g_extra") > 0).cast("long"))
    some = rows.where(split)
    before = W.partitionBy("o_key").orderBy("o_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = some.groupBy(F.col("key").alias("o_key"), F.col("part").alias("o_part")).agg(F.count(F.lit(1)).alias("o_n"))
    offsets = offsets.withColumn("o_n", F.coalesce(F.sum("o_n").over(before), F.lit(0)))
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("key", "part").orderBy(order)))
    some = some.join(offsets, (F.col("key") == F.col("o_key")) & (F.col("part") == F.col("o_part"))).drop("o_key", "o_part")
    some = some.withColumn(out, (F.col("nth") + F.col("o_n") <= F.col("g_extra")).cast("long")).drop("nth", "o_n")
    return whole.unionByName(some).drop("g_n", "g_extra", "part")


def row_key(docs: DataFrame) -> Column:
    """md5 of id, source and text."""
    return F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "source", "text")]))


def pareto_mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeat: int = MAX_REPEAT,
               exponent: float = EXPONENT, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text) as (doc_id, source, size, source_size, target, copies, taken, key).

    ``copies`` is the number of times the mix holds the document, ``taken`` is ``copies * size``;
    ``key`` is the md5 of id, source and text that the ranking hashes.
    """
    sized = columns_of(docs, "doc_id", "source", "text").select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        row_key(docs).alias("key"), F.spark_partition_id().alias("part"))
    sized = written(docs.sparkSession, sized, "mix-sizes")  # ids and sizes only; the texts are read once
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    d = ranked(sized, source_targets(sources, weights, share_percent, max_repeat), seed, exponent, bins)
    per_bin = (d.where("bin is not null").groupBy(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"))
               .agg(F.sum("size").alias("bin_size"), F.first("rest").alias("b_rest")))
    upto = W.partitionBy("b_source").orderBy("b_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_bin = per_bin.withColumn("bin_end", F.sum("bin_size").over(upto))
    per_bin = per_bin.withColumn("bin_start", F.col("bin_end") - F.col("bin_size"))
    cut = (per_bin.where("bin_start <= b_rest and bin_end > b_rest")
           .select(F.col("b_source").alias("c_source"), F.col("b_bin").alias("c_bin"), F.col("bin_start")))
    d = d.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    # c_bin is null when the whole fraction fits: then every ranked row is taken
    at_cut = F.col("bin") == F.col("c_bin")
    edge = written(docs.sparkSession, d.where(at_cut), "mix-edge")  # one bin of a source
    # equal rows are one row with a count here, so that the window meets distinct documents only
    groups = edge.groupBy("source", "q", "u", "key").agg(
        F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bin_start").alias("bin_start"), F.first("rest").alias("rest"))
    running = W.partitionBy("source").orderBy("q", "u", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = groups.withColumn("run", F.sum(F.col("size") * F.col("n")).over(running) + F.col("bin_start"))
    # nearest to the target: the row that crosses it is taken if that leaves less than half of it over
    start = F.col("run") - F.col("size") * F.col("n")
    some = F.floor((F.col("rest") - start) / F.col("size") + 0.5).cast("long")
    n_extra = (F.when(F.col("run") - F.col("size") / 2.0 <= F.col("rest"), F.col("n"))
               .when(start + F.col("size") / 2.0 > F.col("rest"), F.lit(0).cast("long"))
               .otherwise(F.greatest(F.lit(1).cast("long"), F.least(some, F.col("n") - 1))))
    edge = first_of_equal(edge, groups.select(F.col("key").alias("g_key"), F.col("n").alias("g_n"), n_extra.alias("g_extra")), "extra")
    rest = d.where(F.coalesce(~at_cut, F.lit(True))).withColumn(
        "extra", F.when(F.col("bin").isNull(), 0).when(F.col("c_bin").isNull() | (F.col("bin") < F.col("c_bin")), 1)
        .otherwise(0).cast("long"))
    out = rest.drop("part").unionByName(edge)
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) + F.col("extra")).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                      copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "key")


def mix_query(docs: DataFrame) -> DataFrame:
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix holds it, with ``copy_no`` from 1 (it replaces a column of that name).

    The plan carries keys only; it is joined back to the rows by the key.
    """
    cols = [c for c in docs.columns if c != "copy_no"]
    plan = (pareto_mix(docs).where("size > 0").groupBy(F.col("key").alias("g_key"))
            .agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("g_n")))
    plan = plan.where("all > 0").withColumn("g_extra", F.col("all") - F.col("least") * F.col("g_n"))
    plan = written(docs.sparkSession, plan, "mix-plan")
    d = docs.select(row_key(docs).alias("key"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    out = (d.join(plan.where("g_extra = 0").select("g_key", F.col("least").alias("copies")), F.col("key") == F.col("g_key")).select("row", "copies"))
    # equal rows that the cut divides: some have a copy more
    uneven = plan.where("g_extra > 0")
    d = docs.select(row_key(docs).alias("key"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.spark_partition_id().alias("part"))
    d = d.join(uneven.select("g_key"), F.col("key") == F.col("g_key"), "left_semi").withColumn("order", F.xxhash64(F.to_json("row")))
    d = first_of_equal(written(docs.sparkSession, d, "mix-equal-rows"), uneven.select("g_key", "g_n", "g_extra", "least"), "extra", "order")
    out = out.unionByName(d.select("row", (F.col("least") + F.col("extra")).alias("copies")))
    return (out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
            .select(*[F.col("row")[c].alias(c) for c in cols], "copy_no"))


#: The same rows in DuckDB. Sizes are exact integers, so both engines rank alike.
MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || chr(1) || coalesce(source, '-') || chr(1) || coalesce(text, '-')) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               sum(floor(pow(size::DOUBLE, 1.25) * 1000)::HUGEINT)::DOUBLE / 1000 / sum(size) AS mean_power
        FROM sized GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
             (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS want FROM src),
lv AS (SELECT *, (want - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level0
       FROM w WINDOW before AS (ORDER BY cap / weight ASC, source ASC NULLS LAST
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
op AS (SELECT *, max(level0) OVER () AS level,
              min(CASE WHEN level0 * weight < cap THEN cap / weight END) OVER () AS first_open FROM lv),
tg AS (SELECT source, source_size, mean_power,
              CASE WHEN first_open IS NOT NULL AND cap / weight >= first_open THEN level * weight ELSE cap END AS target FROM op),
d AS (SELECT s.*, t.source_size, t.mean_power, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
             (('0x' || substr(md5('mix-1:' || s.key), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u
      FROM sized s JOIN tg t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, target - whole * source_size AS rest FROM d),
pp AS (SELECT *, rest / source_size * pow(size::DOUBLE, 0.25::DOUBLE) / mean_power AS pr FROM p),
q AS (SELECT *, CASE WHEN size <= 0 OR rest <= 0 THEN NULL WHEN pr >= 1 THEN 0.0::DOUBLE
                     ELSE (u / (1 - u)) / (pr / (1 - pr)) END AS q FROM pp),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, u, key, doc_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q)
SELECT doc_id, size, source_size, coalesce(target, 0.0) AS target,
       (CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND run - size / 2.0 <= rest THEN 1 ELSE 0 END
             ELSE 0 END * size)::BIGINT AS taken
FROM r
"""
