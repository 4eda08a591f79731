"""Splits that keep related records together.

Records that name a common entity (a recording session, a speaker) are joined into
components by alternating large-star and small-star steps on the distinct entity pairs;
each component then falls into a split by the hash of its identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm.common import hash_unit
from utterlake.session import drop_path, store

#: Speakers are nodes above all session numbers, so the least node of a group is a session.
SPEAKER_BASE = 1 << 61


def path_numbers(path: Column) -> Column:
    """struct<session, channel, speaker> (bigint) named by an audio path.

    Mount, file type, case, separators, leading zeros, percent-encoding and outer blanks
    do not matter; the last session named in the path counts. A part that is not named,
    or a number of more than 18 digits, is null; so is everything for a null path.
    """
    p = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path))

    def number(pattern: str) -> Column:
        # the greedy lead makes the last mention count
        return F.regexp_extract(p, pattern, 1).try_cast("bigint")

    sep = r"[\s_\-]*"
    return F.struct(
        number(rf"(?s)^.*(?<![a-z])ses(?:sion)?{sep}0*([0-9]{{1,18}})(?![0-9])").alias("session"),
        number(rf"(?s)^.*(?<![a-z])ch(?:annel)?{sep}0*([0-9]{{1,18}})(?![0-9])").alias("channel"),
        number(rf"(?s)^.*(?<![a-z])sp(?:ea)?k(?:er)?{sep}0*([0-9]{{1,18}})(?![0-9])").alias("speaker"),
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two bigint columns); the component is
    its least node.

    Alternating large-star and small-star: each round hangs larger neighbours, then smaller
    neighbours, on the least node seen, until nothing changes. A self-edge makes an isolated
    node; edges with a null end are left out; an empty table gives an empty result. Minima
    are aggregated before the shuffle, and a node with very many neighbours is split by the
    adaptive skew join, since no step collects the neighbours of a node.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes, nodes_path = store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    links, path, before = nodes.where("u <> v"), None, None
    for _ in range(max_rounds):
        # large-star: all neighbours; those above u move to the least of them
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: only smaller neighbours; they and u move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last = path
        links, path = store(small, "links", keep=False)
        if last:
            drop_path(spark, last)
        now = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not closed after {max_rounds} rounds")
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    out, _ = store(ends.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    for p in (path, nodes_path):
        drop_path(spark, p)
    return out


def group_records(df: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """(id, group_id) for each record: group_id is the least session number of the records
    that share a session or a speaker with it, directly or through others.

    A record whose path is null, or names neither, gets a null group. Where a group names
    no session at all, its group_id is the negative of its least speaker number less one.
    """
    # repeated rows of a record are equal in both columns and fall together here
    rec = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), path_numbers(F.col(path_col)).alias("_n")).select("_id", "_n.session", "_n.speaker").distinct()
    speaker = F.col("speaker") + F.lit(SPEAKER_BASE)
    # most records repeat a (session, speaker) already named: distinct before anything else
    pairs = rec.where("session is not null or speaker is not null").select(F.coalesce("session", speaker).alias("a"), F.coalesce(speaker, "session").alias("b")).distinct()
    comp = connected_components(pairs)
    keyed = rec.withColumn("node", F.coalesce("session", speaker))
    group = F.when(F.col("component") >= SPEAKER_BASE, -(F.col("component") - F.lit(SPEAKER_BASE)) - 1).otherwise(F.col("component"))
    return keyed.join(comp, "node", "left").groupBy("_id").agg(F.min(group).alias("group_id")).withColumnRenamed("_id", id_col)


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], id_col: str, seed: int = 42, earlier: DataFrame | None = None, large: float | None = None) -> DataFrame:
    """(id, group_id, split) with shares near ``targets`` [(name, share)].

    The hash of the group falls into one of the ranges that the shares cut out of [0, 1), so
    a group's split depends on nothing but its id and the targets: added data move none.
    ``earlier`` (group_id, split), an assignment made before, is kept for the groups it names.
    Records without a group stand for themselves. Shares are scaled to sum 1; targets
    without a positive share get nothing; without any there is a ValueError. What is reached
    is reported by :func:`split_shares`.

    With ``large`` the groups of more than this part of all records (fewer than 1/large), which
    distort the shares most, are placed first instead, each into the split that lacks most, and
    the ranges for the others follow what is then wanted. That depends on the data: store the
    assignment and hand it back as ``earlier`` when they grow.
    """
    names = sorted((n, float(s)) for n, s in targets if n is not None and s is not None and s > 0)
    if not names:
        raise ValueError("no split has a positive share")
    whole = sum(s for _, s in names)
    want = {n: s / whole for n, s in names}
    known = None if earlier is None else earlier.where("group_id is not null and split is not null").groupBy("group_id").agg(F.min("split").alias("_fixed"))
    if large is not None:
        total = groups.count()
        sizes = groups.where("group_id is not null").groupBy("group_id").count()
        if known is not None:
            sizes = sizes.join(known, "group_id", "left_anti")
        placed = {}
        for r in sizes.where(F.col("count") > F.lit(large * total)).orderBy(F.desc("count"), "group_id").collect():
            to = max(want, key=lambda n: (want[n], n))
            placed[r["group_id"]] = to
            want[to] -= r["count"] / total
        want = {n: max(0.0, w) for n, w in want.items()}
        fixed = groups.sparkSession.createDataFrame(list(placed.items()), f"group_id {groups.schema['group_id'].dataType.simpleString()}, _fixed string")
        known = fixed if known is None else known.unionByName(fixed)
    left = sum(want.values()) or 1.0
    u = hash_unit(F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("r"), F.col(id_col).cast("string"))), seed=seed)
    split = F.lit(names[-1][0])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(u < sum(want[n] for n, _ in names[: i + 1]) / left, names[i][0]).otherwise(split)
    out = groups.select(id_col, "group_id")
    out = out.withColumn("_fixed", F.lit(None).cast("string")) if known is None else out.join(known, "group_id", "left")
    return out.select(id_col, "group_id", F.coalesce("_fixed", split).alias("split"))


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, share, records, reached): what each split of ``targets`` (split_name, share)
    got, and its part of all records."""
    got = assigned.groupBy(F.col("split").alias("split_name")).agg(F.count(F.lit(1)).alias("records"))
    out = targets.join(got, "split_name", "left").fillna(0, ["records"])
    whole = F.sum("records").over(Window.partitionBy(F.lit(1)))  # a row for each split
    return out.select("split_name", "share", "records", F.coalesce(F.col("records") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("reached"))
