"""Version histories: lifetimes, first sightings, deletions, tags and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.numbering import numbered


def lifetimes(events: DataFrame, keys: list[str], last: DataFrame | int) -> DataFrame:
    """``fid`` with ``from_idx`` and ``to_idx``: from its version to the one before the next change, to ``last`` if open.

    ``events`` has the keys, ver_idx and fid; a null fid is a deletion. Bodies of one version share its range.
    """
    distinct = events.select(*keys, "ver_idx").distinct()
    w = Window.partitionBy(*keys).orderBy("ver_idx")
    ranges = distinct.withColumn("next", F.lead("ver_idx").over(w))
    end = F.lit(last) if isinstance(last, int) else F.col("last_idx")
    rows = events.join(ranges, [*keys, "ver_idx"])
    rows = rows if isinstance(last, int) else rows.join(last, keys[:1])
    return rows.where("fid IS NOT NULL").select(*keys, "fid", F.col("ver_idx").alias("from_idx"), F.coalesce(F.col("next") - 1, end).cast("long").alias("to_idx")).distinct()


def islands(lives: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of the same body that touch, as one."""
    w = Window.partitionBy(*keys, "fid").orderBy("from_idx")
    fresh = F.when(F.col("from_idx") <= F.max("to_idx").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    numbered = lives.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return numbered.groupBy(*keys, "fid", "island").agg(F.min("from_idx").alias("from_idx"), F.max("to_idx").alias("to_idx")).drop("island")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first version of each (keys, fid), with what it brought."""
    rest = [c for c in events.columns if c not in (*keys, "fid")]
    return events.where("fid IS NOT NULL").groupBy(*keys, "fid").agg(F.min(F.struct("ver_idx", *[c for c in rest if c != "ver_idx"])).alias("x")).select(*keys, "fid", "x.*")


def deletions(state: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """Tokens that a file had in its previous version and no touched file has in this one.

    ``state``: path, ver_idx and the keys of each token; ``touched``: path, ver_idx of files that a version changed.
    """
    w = Window.partitionBy("path").orderBy("ver_idx")
    before = touched.withColumn("prior", F.lag("ver_idx").over(w)).where("prior IS NOT NULL")
    old = before.join(state.withColumnRenamed("ver_idx", "prior"), ["path", "prior"]).select("ver_idx", *keys).distinct()
    return old.join(state.select("ver_idx", *keys).distinct(), ["ver_idx", *keys], "left_anti")


def token_states(state: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """What a version does to each token of the files it touches: ``ver_idx``, the keys, ``old`` and ``new``, the numbers of
    bodies before and after it. A token with old bodies and no new one is deleted.

    ``state``: path, ver_idx, the keys and fid of the files as a version left them; a removed file is touched and has none.
    """
    before = touched.withColumn("prior", F.lag("ver_idx").over(Window.partitionBy("path").orderBy("ver_idx"))).where("prior IS NOT NULL")
    old = before.join(state.withColumnRenamed("ver_idx", "prior"), ["path", "prior"]).groupBy("ver_idx", *keys).agg(F.countDistinct("fid").alias("old"))
    new = state.groupBy("ver_idx", *keys).agg(F.countDistinct("fid").alias("new"))
    return old.join(new, ["ver_idx", *keys], "full_outer").fillna(0, ["old", "new"])


def replay(state: DataFrame, keys: list[str], touched: DataFrame, valid: Column, last: int) -> DataFrame:
    """``keys``, ``fid``, ``from_idx``, ``to_idx``: the lifetimes that a history of file versions comes to.

    ``state`` and ``touched`` as for ``token_states``; files that aren't ``valid`` are left out. The state of a version
    before the next needs no replay in order: a window finds it for all files at once.
    """
    state, touched = state.where(valid), touched.where(valid)
    gone = token_states(state, keys, touched).where("old > 0 AND new = 0").select(*keys, "ver_idx", F.lit(None).cast("long").alias("fid"))
    return lifetimes(state.select(*keys, "ver_idx", F.col("fid").cast("long").alias("fid")).distinct().unionByName(gone), keys, last)


def signatures(holds: DataFrame) -> DataFrame:
    """One JSON row for each function of a repository (repo, fid, ver) with the versions that have it, in order."""
    vers = F.transform(F.array_sort(F.collect_set("ver")), lambda v: v.cast("string"))
    rows = holds.groupBy("repo", "fid").agg(vers.alias("vers"))
    return rows.select("repo", F.struct(F.col("fid").cast("string").alias("hash"), "vers").alias("sig"))


def version_index(holds: DataFrame) -> DataFrame:
    """One row for each version of a repository with its place, from 0."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("ver")) - 1
    return holds.select("repo", "ver").distinct().select("repo", F.struct(F.col("ver").cast("string").alias("ver"), place.cast("string").alias("idx")).alias("idx"))


def ranked_tags(tags: DataFrame, k: int, newest: bool = True) -> DataFrame:
    """The k newest or oldest tags of each repository."""
    order = (F.desc("date"), F.desc("tag")) if newest else (F.asc("date"), F.asc("tag"))
    return tags.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("n") <= k)


def created(repos: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """The first tag's date of each repository, else its first commit's."""
    t = tags.groupBy("repo").agg(F.min("date").alias("t"))
    c = commits.groupBy("repo").agg(F.min("date").alias("c"))
    return repos.join(t, "repo", "left").join(c, "repo", "left").select("repo", F.coalesce("t", "c").alias("created"))


def assign_fids(repo_hashes: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """``fid`` of each distinct digest, from 1 in sorted order; new ones go on after those of ``catalogue``. Zero is no body."""
    distinct = repo_hashes.where("fhash <> ''").select("fhash").distinct()
    if catalogue is None:
        return numbered(distinct, "fhash", name="fid")
    new = numbered(distinct.join(catalogue, "fhash", "left_anti"), "fhash", name="fid")
    top = catalogue.agg(F.coalesce(F.max("fid"), F.lit(0))).scalar()
    return catalogue.select("fhash", "fid").unionByName(new.select("fhash", (F.col("fid") + top).alias("fid")))
