"""Point-in-time feature join: the version of a record that was known and valid at each question's time.

Versions and questions meet in one range-frame window. A window's partition is a key and a stretch of time, so a key of any
size is split, and a version stands in each stretch that its life touches. What can never win is left out before: among
versions that become usable at the same time, one that a better one outlives. So a partition is bounded by the length of a
life in time units, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import table


def contenders(versions: DataFrame, lifetime: int) -> DataFrame:
    """Versions (key, event, arrival, expiry, best) that win at some time, perhaps: ``key``, ``start``, ``expiry``, ``best``.

    A version is usable from its event or its arrival on, whichever is later, and until its expiry, ``lifetime`` after the
    event at most. ``best`` is the struct by which versions are compared. Versions with a null time or key are never
    usable. The first grouping is combined in the map tasks; the window's groups hold a row for each expiry at most.
    """
    start, end = F.greatest("event", "arrival"), F.least(F.col("expiry"), F.col("event") + lifetime)
    usable = versions.where("key IS NOT NULL AND event IS NOT NULL AND arrival IS NOT NULL AND expiry IS NOT NULL")
    rows = usable.select("key", start.alias("start"), end.alias("expiry"), "best").where("start < expiry")
    rows = rows.groupBy("key", "start", "expiry").agg(F.max("best").alias("best"))
    before = Window.partitionBy("key", "start").orderBy(F.desc("best")).rowsBetween(Window.unboundedPreceding, -1)
    outlived = F.coalesce(F.col("expiry") <= F.max("expiry").over(before), F.lit(False))
    return rows.withColumn("outlived", outlived).where("NOT outlived").drop("outlived")


def winners(versions: DataFrame, questions: DataFrame, lifetime: int) -> DataFrame:
    """``key``, ``at``, ``best`` of the winning version for each of the distinct ``questions`` (key, at); none, no row."""
    stretch = lambda c: c - F.pmod(c, F.lit(lifetime))
    rows = contenders(versions, lifetime)
    entry = F.struct("start", "expiry", "best").alias("entry")
    event = F.col("best.event").alias("time")
    lives = rows.select("key", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("expiry") - 1), F.lit(lifetime))).alias("stretch"), event, entry, F.lit(False).alias("asks"))
    asked = questions.select("key", stretch(F.col("at")).alias("stretch"), F.col("at").alias("time"), F.lit(None).cast(lives.schema["entry"].dataType).alias("entry"), F.lit(True).alias("asks"))
    frame = Window.partitionBy("key", "stretch").orderBy("time").rangeBetween(-lifetime, 0)
    met = lives.unionByName(asked).withColumn("near", F.collect_list("entry").over(frame)).where("asks")
    usable = F.filter("near", lambda x: (x["start"] <= F.col("time")) & (F.col("time") < x["expiry"]))
    return met.select("key", F.col("time").alias("at"), F.array_max(F.transform(usable, lambda x: x["best"])).alias("best")).where("best IS NOT NULL")


def point_in_time(versions: DataFrame, questions: DataFrame, key: str, event: Column, arrival: Column, expiry: Column, at: Column, lifetime: int, by: list[str], keep: list[str], out: str = "winner") -> DataFrame:
    """All rows and columns of ``questions`` with ``out``: the winning version's struct (event, arrival, ``by``, ``keep``), or null.

    A version of the same ``key`` is usable where event <= at and arrival <= at < expiry, and for less than ``lifetime`` after
    its event; times are whole numbers. The latest event wins, then the latest arrival, then the largest ``by`` columns and
    then ``keep`` columns, null the least, so repeated versions make no difference. Repeated questions keep their rows; a null
    key or time has no winner, and an empty table gives none. A column of ``questions`` named ``out`` is replaced, other names
    never clash: rows travel inside a struct. ``by`` and ``keep`` columns need an order.
    """
    time = lambda c: c.cast("long")
    best = F.struct(time(event).alias("event"), time(arrival).alias("arrival"), *by, *keep)
    rows = versions.select(F.col(key).alias("key"), time(event).alias("event"), time(arrival).alias("arrival"), time(expiry).alias("expiry"), best.alias("best"))
    asked = questions.select(F.col(key).alias("key"), time(at).alias("at"), F.struct(*questions.columns).alias("row"))
    known = asked.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at").distinct()
    found = asked.join(winners(rows, known, lifetime), ["key", "at"], "left")
    return found.select(*(F.col("row")[c].alias(c) for c in questions.columns if c != out), F.col("best").alias(out))


#: Folds of the query: the range of events, how late a version may arrive, how long it lives, and when it counts as stale.
SPAN, EARLY, LATE, LIFE, STALE = 200_000, 60, 1200, 900, 20


def _fold(group: int) -> Column:
    """One of the first eight-digit groups of the sha256 of a decimal id, as a number; null for a null id."""
    return F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * group + 1, 8), 16, 10).cast("long")


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of its source that each label's document meets: the newest that had arrived and had not expired.

    A label of an unknown document, or of one without a source, has no version. Of documents with equal ids the largest
    source counts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    event = _fold(0) % SPAN
    sources = docs.groupBy("doc_id").agg(F.max("source").alias("source"))
    asked = table(spark, sf_dir, "labels").select("doc_id", (_fold(3) % SPAN).alias("t")).join(sources, "doc_id", "left")
    found = point_in_time(docs, asked, "source", event, event - EARLY + _fold(1) % LATE, event + _fold(2) % LIFE, F.col("t"), LIFE, ["doc_id"], ["n_chars", "lang"])
    won, age = F.col("winner"), F.col("t") - F.col("winner.event")
    status = F.when(won.isNull(), "none").when(age > STALE, "stale").otherwise("fresh")
    fresh = lambda c: F.when(F.col("status") == "fresh", F.col(f"winner.{c}")).alias(c)
    return found.withColumn("status", status).select("doc_id", "t", F.col("winner.doc_id").alias("version_id"), age.alias("age"), "status", fresh("n_chars"), fresh("lang"))


_PART = "CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), {}, 8) AS BIGINT)"
OP12_SQL = f"""WITH v AS (SELECT *, {_PART.format(1)} % {SPAN} AS event FROM documents), w AS (SELECT source, doc_id, n_chars, lang, event, event - {EARLY} + {_PART.format(9)} % {LATE} AS arrival, event + {_PART.format(17)} % {LIFE} AS expiry FROM v),
q AS (SELECT row_number() OVER () AS k, l.doc_id, {_PART.format(25).replace("doc_id", "l.doc_id")} % {SPAN} AS t, s.source FROM labels l LEFT JOIN (SELECT doc_id, max(source) AS source FROM documents GROUP BY doc_id) s ON s.doc_id = l.doc_id),
m AS (SELECT q.k, q.doc_id, q.t, w.doc_id AS version_id, q.t - w.event AS age, w.n_chars, w.lang, row_number() OVER (PARTITION BY q.k ORDER BY w.event DESC NULLS LAST, w.arrival DESC, w.doc_id DESC, w.n_chars DESC, w.lang DESC) AS n
FROM q LEFT JOIN w ON w.source = q.source AND w.event <= q.t AND w.arrival <= q.t AND q.t < w.expiry),
s AS (SELECT *, CASE WHEN version_id IS NULL THEN 'none' WHEN age > {STALE} THEN 'stale' ELSE 'fresh' END AS status FROM m WHERE n = 1)
SELECT doc_id, t, version_id, age, status, CASE WHEN status = 'fresh' THEN n_chars END AS n_chars, CASE WHEN status = 'fresh' THEN lang END AS lang FROM s"""
