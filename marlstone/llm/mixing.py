"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the wanted mix are dealt as equal blocks: first to the sources, then down a tree of
their shards, ``FAN_OUT`` nodes at a time, each time by the highest quotients
``weight / (2 k + 1)``. Every level hands down whole numbers of blocks, so the quotas of
the shards add up to that of their source. Within a shard the documents lie end to end in
a seeded order, and a seeded, evenly spaced choice of blocks fills the quota. A document's
share follows from its place alone, in closed form, so that no row is made per block.

A document's shard and place follow from a hash of its id and text, so a busy source, one repeated or null id and
copies of one text are all spread over shards; rows alike in both are spread by their place in the table.

Defined results: a null or empty text has no words and takes none; a very long text is one document, whose words count
in Spark's own functions; a null source is a source of its own, after all others; a null ``doc_id`` is a document
like any other; equal rows are separate documents; an empty table gives an empty result. Columns of the input
other than the three named ones are ignored, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import local_table, materialize, n_words, table, words

#: Nodes below one node of the tree of shards; their quotas are dealt in one task.
FAN_OUT = 256


def capped_shares(total: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Share ``total`` by ``weights``; what exceeds a cap is shared again among the rest."""
    shares, open_ = [0.0] * len(weights), set(range(len(weights)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] * unit > caps[i]]
        if not over:
            for i in open_:
                shares[i] = weights[i] * unit
            break
        for i in over:
            shares[i] = float(caps[i])
            left -= caps[i]
            open_.discard(i)
    return shares


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by the highest quotients ``w / (2 k + 1)``; ties go to the earlier party.

    A party with ``caps[i]`` seats takes no more. A bisection over the lowest winning
    quotient gives nearly all seats at once; the last few are dealt one by one.
    """
    n, seats = len(weights), min(int(seats), sum(caps))
    got = [0] * n
    if seats <= 0:
        return got

    def at(q: float) -> list[int]:
        return [min(c, max(0, int((w / q + 1) / 2))) for w, c in zip(weights, caps, strict=True)]

    high = max(weights) * 2
    low = high
    while sum(at(low)) < seats and low > 1e-300:
        low /= 2
    for _ in range(200):
        if high - low <= low * 1e-13:
            break
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid)) >= seats else (low, mid)
    got = [max(0, s - 1) for s in at(high)]  # one less, as the division may round up
    queue = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights, got, caps, strict=True)) if k < c and w > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _deal(rows: pd.DataFrame) -> pd.DataFrame:
    """Quotas of the nodes below one node, at most FAN_OUT rows."""
    rows = rows.sort_values("node")
    rows["quota"] = sainte_lague(rows["w"].tolist(), int(rows["parent_quota"].iloc[0]), rows["cap"].tolist())
    return rows[["skey", "node", "w", "quota"]]


def _dealt(shards: DataFrame, top: DataFrame, most_shards: int) -> DataFrame:
    """(skey, node, w, quota) of every shard, from ``top``'s (skey, parent, parent_quota), level by level.

    A level's nodes are the shards by whole powers of FAN_OUT, so each task deals to at most FAN_OUT of them.
    """
    depth = 1
    while FAN_OUT**depth < most_shards:
        depth += 1
    quotas = top
    for level in reversed(range(depth)):
        nodes = shards.withColumn("node", F.expr(f"shard div {FAN_OUT**level}"))
        if level:
            nodes = nodes.groupBy("skey", "node").agg(F.sum("w").alias("w"), F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("parent", F.expr(f"node div {FAN_OUT}")).join(quotas, ["skey", "parent"])
        quotas = nodes.select("skey", "parent", "node", "w", "cap", "parent_quota").groupBy("skey", "parent").applyInPandas(_deal, "skey string, node long, w long, quota long")
        if level:
            quotas = quotas.select("skey", F.col("node").alias("parent"), F.col("quota").alias("parent_quota"))
    return quotas


def seeded(seed: int, *cols: Column) -> Column:
    """60 seeded bits of the given columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(rows: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, repeat: float) -> list[tuple[str | None, int, float]]:
    """(source, words, target) in order of code points, null last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    own = [float(weights[i % len(weights)]) for i in range(len(rows))]
    sizes = [int(r[1]) for r in rows]
    targets = capped_shares(share * sum(sizes), own, [repeat * s for s in sizes])
    return [(r[0], s, t) for r, s, t in zip(rows, sizes, targets, strict=True)]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    repeat: int = 2,
    block_words: int = 32,
    docs_per_shard: int = 256,
    max_sources: int = 1_000_000,
    seed: int = 42,
) -> DataFrame:
    """The plan of the mix, one row per document.

    ``doc_id, source, size, source_size, target, taken`` and, for whoever cuts the texts:
    ``full_passes`` (whole copies), ``start`` (first word's place in the shard),
    ``blocks``, ``picked`` and ``phase`` (the shard's choice of blocks, see ``block_taken``). With ``key_col``, a
    column of unique longs, also that as ``key``. Targets are set on the driver, one row per source; more
    than ``max_sources`` of them are an error.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(text).alias("size"),
            seeded(seed, F.col(id_col), F.md5(text.cast("binary"))).alias("order"),
            (F.col(key_col) if key_col else F.monotonically_increasing_id()).alias("key"),
        ),
        "mix-sizes",
    ).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))

    per_source = sized.groupBy("skey", "source").agg(F.count("*").alias("n"), F.sum("size").alias("w")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    targets = source_targets([(r.source, r.w) for r in per_source], weights, share, repeat)
    count = {r.source: r.n for r in per_source}
    keys = [("n" if s is None else "s" + s) for s, _, _ in targets]
    n_shards = {k: -(-count[s] // docs_per_shard) for k, (s, _, _) in zip(keys, targets, strict=True)}
    blocks_wanted = math.floor(sum(t for _, _, t in targets) / block_words + 0.5 + 1e-6)  # halves up, whatever the sum's rounding
    quota = sainte_lague([t for _, _, t in targets], blocks_wanted, [-(-repeat * s // block_words) for _, s, _ in targets])
    sources = local_table(
        spark,
        {"skey": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "shards": pa.int64(), "parent": pa.int64(), "parent_quota": pa.int64()},
        [(k, int(s), float(t), int(n_shards[k]), 0, int(q)) for k, (_, s, t), q in zip(keys, targets, quota, strict=True)],
    )
    # Rows alike in id and text would lie in one shard; where there are many, they are spread by their keys.
    alike = sized.groupBy("skey", "order").agg(F.count("*").alias("_alike")).where(F.col("_alike") > 4 * docs_per_shard)
    alike = materialize(alike, "mix-alike")
    lot = F.col("key") % F.ceil(F.col("_alike") / docs_per_shard)
    # Spark itself broadcasts these tables only if they are below its threshold.
    placed = sized.join(sources.drop("parent", "parent_quota"), "skey").join(alike, ["skey", "order"], "left")
    placed = placed.withColumn("order", F.when(F.col("_alike").isNull(), F.col("order")).otherwise(seeded(seed, F.col("order"), lot)))
    placed = placed.withColumn("shard", F.col("order") % F.col("shards"))
    shards = placed.groupBy("skey", "shard").agg(F.sum("size").alias("w"))
    shards = materialize(shards.withColumn("cap", F.ceil(F.col("w") * repeat / block_words)), "mix-shards")
    quotas = _dealt(shards, sources.select("skey", "parent", "parent_quota"), max(n_shards.values(), default=1))

    lane = Window.partitionBy("skey", "shard")
    laid = (
        placed.join(quotas.withColumnRenamed("node", "shard"), ["skey", "shard"])
        .withColumn("end", F.sum("size").over(lane.orderBy("order", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    words_wanted = F.least(F.col("quota") * block_words, F.col("w") * repeat)
    blocks = F.greatest(F.expr(f"w div {block_words}"), F.lit(1).cast("long"))
    laid = (
        laid.withColumn("wanted", words_wanted)
        .withColumn("full_passes", F.when(F.col("w") > 0, F.expr("wanted div w")).otherwise(F.lit(0).cast("long")))
        .withColumn("blocks", blocks)
        .withColumn(
            "picked",
            F.least(F.round((F.col("wanted") - F.col("full_passes") * F.col("w")) / block_words).cast("long"), F.col("blocks")),
        )
        .withColumn("phase", seeded(seed, F.col("skey"), F.col("shard")) % F.col("blocks"))
    )
    extra = block_taken(F.col("end"), block_words) - block_taken(F.col("start"), block_words)
    return laid.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("full_passes") * F.col("size") + F.when(F.col("size") > 0, extra).otherwise(0)).cast("long").alias("taken"),
        "full_passes",
        "start",
        "blocks",
        "picked",
        "phase",
        *(["key"] if key_col else []),
    )


def block_taken(place: Column, block_words: int) -> Column:
    """How many of the shard's words before ``place`` lie in picked blocks.

    Block j is picked if ``(j * picked + phase) div blocks`` grows from j to j + 1: exactly
    ``picked`` of ``blocks`` blocks, evenly spaced from a seeded start. Words after the last
    whole block belong to no block.
    """

    def picked(block: Column) -> Column:
        return F.floor((block * F.col("picked") + F.col("phase")) / F.col("blocks"))

    block = F.least(F.floor(place / block_words), F.col("blocks"))
    inside = F.when(block < F.col("blocks"), place - block * block_words).otherwise(0)
    return picked(block) * block_words + inside * (picked(block + 1) - picked(block))


def cut_mix(docs: DataFrame, *, block_words: int = 32, **settings) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: whole copies, then a row of picked words.

    A document that the mix takes 1.4 times gives one whole row and one with the words of
    its picked blocks. ``n_chars``, if there, follows the text. A row is held as one value with a key of its
    own, by which it meets its plan: null and repeated ids are documents like any others, and
    columns of any name are carried.
    """
    cols = docs.columns
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.monotonically_increasing_id().alias("key")), "mix-rows")
    named = keyed.select("key", *[F.col("row")[c].alias(f"_{c}") for c in ("doc_id", "text", "source")])  # the scan reads these fields alone
    plan = mix_sources(named, key_col="key", id_col="_doc_id", text_col="_text", source_col="_source", block_words=block_words, **settings)
    both = keyed.select("key", "row").join(plan.select("key", "size", "taken", "full_passes", "start", "blocks", "picked", "phase"), "key")
    extra = F.col("taken") - F.col("full_passes") * F.col("size")

    def in_block(_, i):
        at = F.floor((F.col("start") + i) / block_words)
        count = lambda b: F.floor((b * F.col("picked") + F.col("phase")) / F.col("blocks"))
        return (at < F.col("blocks")) & (count(at + 1) > count(at))

    part = F.array_join(F.filter(words(F.col("row")["text"]), in_block), " ")
    copies = F.concat(
        F.array_repeat(F.col("row")["text"], F.col("full_passes").cast("int")),
        F.when(extra > 0, F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    out = both.select("row", F.explode(copies).alias("cut"))
    return out.select(
        *[
            F.col("cut").alias(c) if c == "text" else F.length("cut").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
            for c in cols
        ]
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_SQL_COUNTS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def _sql_seeded(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', '42', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts) + ")), 1, 15) AS BIGINT)"


def _sql_deal(name: str, rows: str, key: str, order: str) -> str:
    """CTE of the seats of ``rows`` (key columns, q: weight, cap, seats) by the highest quotients within ``key``."""
    lane = f"PARTITION BY {key} ORDER BY q / (2 * k + 1) DESC, {order}" if key else f"ORDER BY q / (2 * k + 1) DESC, {order}"
    return f"""{name} AS (SELECT {", ".join(x for x in (key, order) if x)}, count(*) FILTER (rn <= seats) AS quota FROM (
      SELECT *, row_number() OVER ({lane}) AS rn FROM (SELECT *, unnest(range(0, cap)) AS k FROM ({rows}))) GROUP BY ALL)"""


def _sql_taken(place: str) -> str:
    block = f"least({place} // 32, blocks)"
    picked = lambda b: f"((({b}) * picked + phase) // blocks)"
    return f"({picked(block)} * 32 + CASE WHEN {block} < blocks THEN {place} - {block} * 32 ELSE 0 END * ({picked(block + ' + 1')} - {picked(block)}))"


#: ``op1_mixing`` by listing every quotient; up to FAN_OUT squared shards a source, rows alike not spread.
OP1_SQL = f"""
  WITH sized AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, CAST({_SQL_COUNTS} AS BIGINT) AS size, {_sql_seeded("doc_id", "md5(text)")} AS ord FROM documents),
  own AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM (
    SELECT skey, source, CAST(sum(size) AS BIGINT) AS s, ceil(count(*) / 256.0)::BIGINT AS shards FROM sized GROUP BY ALL)),
  weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 1.5::DOUBLE * sum(s) OVER () AS total FROM own),
  units AS (SELECT *, 2 * s / weight AS ratio, (total - coalesce(sum(2 * s) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS unit
    FROM weighed WINDOW below AS (ORDER BY 2 * s / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  level AS (SELECT coalesce((SELECT unit FROM units WHERE ratio >= unit ORDER BY ratio, i LIMIT 1), 1e300) AS u),
  target AS (SELECT skey, i, s, shards, least(weight * u, 2 * s)::DOUBLE AS target FROM weighed, level),
  {_sql_deal("per_source", "SELECT skey, i, target AS q, CAST(ceil(2 * s / 32.0) AS BIGINT) AS cap, (SELECT floor(sum(target) / 32 + 0.5 + 1e-6) FROM target) AS seats FROM target", "", "i, skey")},
  placed AS (SELECT z.*, t.s, t.target, z.ord % t.shards AS shard FROM sized z JOIN target t USING (skey)),
  shard AS (SELECT skey, shard, shard // 256 AS grp, CAST(sum(size) AS BIGINT) AS w, CAST(ceil(sum(size) * 2 / 32.0) AS BIGINT) AS cap FROM placed GROUP BY ALL),
  {_sql_deal("per_grp", "SELECT skey, grp, CAST(sum(w) AS DOUBLE) AS q, CAST(sum(cap) AS BIGINT) AS cap, any_value(p.quota) AS seats FROM shard LEFT JOIN per_source p USING (skey) GROUP BY skey, grp", "skey", "grp")},
  {_sql_deal("per_shard", "SELECT skey, grp, shard, CAST(w AS DOUBLE) AS q, cap, g.quota AS seats FROM shard JOIN per_grp g USING (skey, grp)", "skey, grp", "shard")},
  wanted AS (SELECT skey, shard, w, least(coalesce(quota, 0) * 32, w * 2) AS want, greatest(w // 32, 1) AS blocks FROM shard LEFT JOIN per_shard USING (skey, grp, shard)),
  picks AS (SELECT *, CASE WHEN w > 0 THEN want // w ELSE 0 END AS passes, {_sql_seeded("skey", "shard")} % blocks AS phase FROM wanted),
  chosen AS (SELECT *, least(CAST(round((want - passes * w) / 32.0) AS BIGINT), blocks) AS picked FROM picks),
  laid AS (SELECT p.*, c.* EXCLUDE (skey, shard), CAST(sum(size) OVER (PARTITION BY p.skey, p.shard ORDER BY ord, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
    FROM placed p JOIN chosen c ON c.skey = p.skey AND c.shard = p.shard)
  SELECT doc_id, size, s AS source_size, target,
    CAST(passes * size + CASE WHEN size > 0 THEN {_sql_taken("stop")} - {_sql_taken("(stop - size)")} ELSE 0 END AS BIGINT) AS taken FROM laid"""
