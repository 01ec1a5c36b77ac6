"""Duplicates, interval overlaps, leakage groups and leakage-free splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.digests import domain_digest
from tidewatch.operators import ranks
from tidewatch.operators.components import connected_components
from tidewatch.session import stored


def duplicate_summary(df: DataFrame, fingerprint: str, file: str | None = None) -> DataFrame:
    """Groups of equal fingerprints, their rows and the rows beyond the first; per file if one is named."""
    keys = [fingerprint] + ([file] if file else [])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = groups.groupBy(*([file] if file else [])).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))
    return out


def feature_summary(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row: vectors, repeated vectors, their rows, and vectors and rows with conflicting labels."""
    groups = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels"))
    return groups.agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"),
        F.count_if(F.col("labels") > 1).alias("conflicting"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("n"))), F.lit(0)).alias("conflicting_rows"),
    )


def overlap_islands(df: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """`df` with `island` (per key): rows whose closed intervals touch or overlap, directly or through others.

    A key is cut into parts by start; the latest end and the number of islands before a part are carried over."""
    order = [F.col(key), F.col(start), F.col(end), F.col(row_id)]
    placed = ranks.carried(ranks.in_parts(df, [], order), [key], F.max(end), "_latest", F.max)
    inside = Window.partitionBy(key, ranks.PART).orderBy(*order[1:])
    before = F.greatest("_latest", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0).cast("long")
    placed = stored(placed.withColumn("_new", new).drop("_latest"), "islands")
    placed = ranks.carried(placed, [key], F.sum("_new"), "_islands")
    island = F.coalesce("_islands", F.lit(0)) + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("island", island).drop("_new", "_islands", ranks.PART)


def overlap_summary(islands: DataFrame, key: str) -> DataFrame:
    """One row: components, those of several rows, their rows, and the largest."""
    sizes = islands.groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") > 1).alias("overlapping"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("overlapping_rows"), F.max("n").alias("largest"))


def _by_fingerprint(df: DataFrame, row_id: str, fingerprint: str) -> DataFrame:
    """Rows that have an id, with `_f`: their fingerprint, or their own id where they have none."""
    own = F.concat(F.lit("\0row:"), F.col(row_id).cast("string"))
    return df.where(F.col(row_id).isNotNull()).withColumn("_f", F.coalesce(F.col(fingerprint).cast("string"), own))


def _tied(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(_f, component) of the fingerprints that overlapping intervals of a key tie to others, transitively.

    Rows of one fingerprint are one node, so that only islands of several fingerprints give edges: each a star to its smallest one."""
    near = rows.where(F.col(key).isNotNull()).select("_f", F.col(key).alias("_k"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    islands = overlap_islands(near, "_k", "_start", "_end", "_f").select("_f", "_k", "island")
    first = islands.groupBy("_k", "island").agg(F.min("_f").alias("_to"), F.max("_f").alias("_last")).where("_to <> _last").drop("_last")
    edges = islands.join(first, ["_k", "island"]).select(F.col("_f").alias("src"), F.col("_to").alias("dst"))
    return connected_components(edges).withColumnRenamed("node", "_f")


def leakage_groups(df: DataFrame, row_id: str, fingerprint: str, key: str, start: str, end: str) -> DataFrame:
    """(row_id, root) of rows tied by equal fingerprints or overlapping intervals of a key, transitively; an id is one row's.

    root is the smallest id reachable: that of the fingerprint, or of all fingerprints that are tied to it. Minima are combined
    before they are shuffled, and rows get theirs by a join, which adaptive execution splits for a fingerprint of very many rows."""
    rows = _by_fingerprint(df.select(*dict.fromkeys([row_id, fingerprint, key, start, end])), row_id, fingerprint)
    least = rows.groupBy("_f").agg(F.min(row_id).alias("_least"))
    tied = stored(_tied(rows, key, start, end), "tied")
    across = least.join(tied, "_f").groupBy("component").agg(F.min("_least").alias("_root"))
    across = stored(tied.join(across, "component").select("_f", "_root"), "tied-roots")
    roots = least.join(across, "_f", "left").select("_f", F.coalesce("_root", "_least").alias("root"))
    found = rows.select(row_id, "_f").join(roots, "_f").select(row_id, "root")
    return found.unionByName(df.where(F.col(row_id).isNull()).select(row_id, F.col(row_id).alias("root")))


#: Quarantine reasons by bit, in order of priority.
REASONS = ("unusable_interval", "mixed_files", "mixed_labels", "crosses_boundary", "oversized")


def _measures(boundary: Column) -> list[Column]:
    """What decides on a group, from its rows; `_merged` has the same of several groups."""
    return [
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("attacks"), F.count_if(~F.col("usable")).alias("_bad"), F.count_if(F.col("start") >= boundary).alias("_late"),
        F.min("file").alias("_file"), F.max("file").alias("_file_last"), F.min("label").alias("_label"), F.max("label").alias("_label_last"),
    ]


def _merged() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("rows", "attacks", "_bad", "_late")], *[f(c).alias(c) for c in ("_file", "_label") for f, c in ((F.min, c), (F.max, f"{c}_last"))]]


def _decided(g: DataFrame, oversized: int, domain: str, holdout_fifths: int) -> DataFrame:
    """(root, rows, attacks, mask, reason, disposition, _label, _label_last) of groups with their measures."""
    several = {c: F.coalesce(F.col(c) != F.col(f"{c}_last"), F.lit(False)) for c in ("_file", "_label")}
    tests = [F.col("_bad") > 0, several["_file"], several["_label"], (F.col("_late") > 0) & (F.col("_late") < F.col("rows")), F.col("rows") > oversized]
    mask = F.lit(0)
    primary = F.lit(None).cast("string")
    for bit, test in reversed(list(enumerate(tests))):
        mask = mask + F.when(test, 1 << bit).otherwise(0)
        primary = F.when(test, REASONS[bit]).otherwise(primary)
    share = in_holdout(F.col("root"), domain, holdout_fifths)
    disposition = F.when(mask > 0, "quarantine").when(F.col("_late") > 0, "test").when(share, "validation").otherwise("train")
    return g.select("root", "rows", F.coalesce("attacks", F.lit(0)).alias("attacks"), mask.alias("mask"), primary.alias("reason"), disposition.alias("disposition"), "_label", "_label_last")


def group_decisions(rows: DataFrame, boundary: Column, oversized: int = 1000, domain: str = "tidewatch:split", holdout_fifths: int = 1) -> DataFrame:
    """One row a root: rows, attacks, quarantine mask, primary reason and disposition.

    `rows` has root, file, label, start, usable (boolean). Groups with a reason are quarantined; groups
    after the boundary are test; the others are split by the hash of their root, a fifth to validation."""
    return _decided(rows.groupBy("root").agg(*_measures(boundary)), oversized, domain, holdout_fifths).drop("_label", "_label_last")


def leakage_decisions(df: DataFrame, row_id: str, fingerprint: str, key: str, start: str, end: str, boundary: Column, oversized: int = 1000, domain: str = "tidewatch:split", holdout_fifths: int = 1) -> DataFrame:
    """`group_decisions` of the rows with their `leakage_groups`, and each group's least and largest label (`_label`, `_label_last`).

    `df` has file, label, start, usable beside the named columns. Rows are summed by fingerprint and shuffled once; only the sums of
    fingerprints that are tied to others meet again, so no row is joined with its root."""
    columns = dict.fromkeys([row_id, fingerprint, key, start, end, "file", "label", "start", "usable"])
    rows = _by_fingerprint(df.select(*columns), row_id, fingerprint)
    per = rows.groupBy("_f").agg(F.min(row_id).alias("root"), *_measures(boundary))
    per = per.join(stored(_tied(rows, key, start, end), "tied"), "_f", "left")
    alone = per.where("component is null").drop("_f", "component")
    across = per.where("component is not null").groupBy("component").agg(F.min("root").alias("root"), *_merged()).drop("component")
    return _decided(alone.unionByName(across), oversized, domain, holdout_fifths)


def in_holdout(group: Column, domain: str = "tidewatch:split", fifths: int = 1) -> Column:
    """Whether the SHA-256 of a group id falls in the lowest fifths of its range: its first 16 hex digits
    are compared with those of that share of 2**64."""
    return F.substring(domain_digest(domain, [group]), 1, 16) < F.lit(f"{(1 << 64) * fifths // 5:016x}")


def split_counts(rows: DataFrame) -> DataFrame:
    """(disposition, groups, rows, attacks, share) of (disposition, root, label)."""
    per = rows.groupBy("disposition").agg(F.count_distinct("root").alias("groups"), F.count(F.lit(1)).alias("rows"), F.sum("label").alias("attacks"))
    return per


def split_violations(rows: DataFrame) -> DataFrame:
    """One row: groups in several dispositions, and dispositions that lack a class."""
    across = rows.groupBy("root").agg(F.count_distinct("disposition").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing_groups"))
    lacking = rows.where("disposition <> 'quarantine'").groupBy("disposition").agg(F.count_distinct("label").alias("n")).agg(F.count_if(F.col("n") < 2).alias("one_class_splits"))
    return across.crossJoin(lacking)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """`split_counts` from the decisions themselves, one row a group."""
    return decisions.groupBy("disposition").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum("attacks").alias("attacks"))


def decision_violations(decisions: DataFrame) -> DataFrame:
    """`split_violations` from `leakage_decisions`."""
    across = decisions.groupBy("root").agg(F.min("disposition").alias("_a"), F.max("disposition").alias("_z"))
    across = across.agg(F.count_if(F.col("_a") != F.col("_z")).alias("crossing_groups"))
    kept = decisions.where("disposition <> 'quarantine'").groupBy("disposition").agg(F.min("_label").alias("_a"), F.max("_label_last").alias("_z"))
    return across.crossJoin(kept.agg(F.count_if(F.coalesce(F.col("_a") == F.col("_z"), F.lit(True))).alias("one_class_splits")))


def quarantine_impact(decisions: DataFrame) -> DataFrame:
    """(reason, groups, rows, attacks) for every set bit of the masks."""
    bits = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << b)) != 0, F.lit(r)) for b, r in enumerate(REASONS)]))
    return decisions.withColumn("reason", F.explode(bits)).groupBy("reason").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum("attacks").alias("attacks"))


def policy_violations(assignments: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, n) of assignments (source, role, root, split) against rules (source, role, split): unknown
    sources, splits that the role forbids, and groups in several splits."""
    known = rules.select("source").distinct()
    unknown = assignments.join(known, "source", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("unknown_source"))
    forbidden = assignments.join(known, "source", "left_semi").join(rules, ["source", "role", "split"], "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("forbidden_split"))
    several = assignments.groupBy("root").agg(F.count_distinct("split").alias("s")).where("s > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("group_in_several_splits"))
    return unknown.unionByName(forbidden).unionByName(several).select("kind", "n")


def later_holdout(df: DataFrame, stratum: str, t: str, row_id: str, train_tenths: int = 8) -> DataFrame:
    """`df` with part: the later fifth of every stratum (at least one row, if it has two) is held out."""
    ranked = ranks.with_rank(df, [stratum], [F.col(t).asc_nulls_first(), F.col(row_id).asc()], "_nth", "_n")
    n = F.col("_n")
    cut = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * train_tenths / 10)))).otherwise(n)
    return ranked.withColumn("part", F.when(F.col("_nth") <= cut, "train").otherwise("test")).drop("_nth", "_n")


def balanced_sample(df: DataFrame, label: str, row_id: str, cap: int, floor: int, seed: int = 0) -> DataFrame:
    """`df` with `copy`: classes above `cap` rows give `cap` of them by hash order, classes below `floor` are repeated up to it."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")), 256)
    ranked = ranks.with_rank(df.withColumn("_key", key), [label], [F.col("_key").asc(), F.col(row_id).asc()], "_nth", "_n").where(F.col("_nth") <= cap)
    times = F.when(F.col("_n") >= floor, 1).otherwise(F.floor(F.lit(floor) / F.col("_n")) + (F.col("_nth") <= floor % F.col("_n")).cast("int"))
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).drop("_nth", "_n", "_key")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): smoothed inverse square root of the class share, of mean 1 over the classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"), F.max("n").alias("_m"))
    raw = counts.crossJoin(total).withColumn("_w", F.sqrt(F.col("_m") / F.col("n")))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(mean).select(label, "n", (F.col("_w") / F.col("_mean")).alias("weight"))


def joined_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts: matched, missing on either side, and keys that repeat on either side."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("repeated"),
    )


def shared_vectors(df: DataFrame, features: Sequence[str], split: str, label: str) -> DataFrame:
    """(splits, vectors, rows, conflicting): feature vectors by the set of splits that hold them."""
    groups = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels"), F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits"))
    return groups.groupBy("splits").agg(F.count(F.lit(1)).alias("vectors"), F.sum("n").alias("rows"), F.count_if(F.col("labels") > 1).alias("conflicting"))


def rows_seen_in(test: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """How many rows of `test` have a feature vector that `train` has too."""
    return test.join(train.select(*features).distinct(), list(features), "left_semi").agg(F.count(F.lit(1)).alias("rows"))


def training_frame(
    raw: DataFrame, features: Sequence[str], categories: Sequence[str], label: str = "label", category: str = "attack_cat", duration: str = "dur", packets: Sequence[str] = ("spkts", "dpkts"), required: Sequence[str] = ()
) -> DataFrame:
    """`raw` with its features as numbers, `rate` (packets a second, 0 without a duration), y (0 or 1), category_id (place in
    `categories`, by trimmed lower-cased name; -1 for none) and stratum (Normal, or the category).

    Kept are rows whose features, `required` columns and label are finite numbers, the label 0 or 1, and whose
    category is known if they are attacks."""
    numbers = list(dict.fromkeys([*features, *required, duration, *packets, label]))
    number = {c: F.trim(F.col(c).cast("string")).try_cast("double") for c in numbers if c != "rate"}
    rows = raw.withColumns(number)

    def finite(c: str) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))

    total = sum((F.col(c) for c in packets), F.lit(0.0))
    moving = finite(duration) & (F.col(duration) > 0) & ~F.isnan(total) & (F.abs(total) < float("inf"))
    rows = rows.withColumn("rate", F.coalesce(F.when(moving, total / F.col(duration)), F.lit(0.0)))
    known = F.array(*[F.lit(c.strip().lower()) for c in categories])
    place = F.array_position(known, F.lower(F.trim(F.coalesce(F.col(category).cast("string"), F.lit(""))))) - 1
    rows = rows.withColumns({"category_id": place.cast("int"), "y": F.when(F.col(label) == 1, 1).otherwise(0)})
    kept = F.coalesce(F.col(label).isin(0.0, 1.0), F.lit(False)) & ((F.col("y") == 0) | (F.col("category_id") >= 0))
    for c in dict.fromkeys([*features, *required]):
        kept &= finite(c)
    names = F.array(*[F.lit(c) for c in categories])
    return rows.where(kept).withColumn("stratum", F.when(F.col("y") == 0, "Normal").otherwise(F.get(names, F.col("category_id"))))
