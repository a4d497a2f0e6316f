"""Set-based forms of the workflow reads and writes: upserts, latest rows, visibility, pages."""

from __future__ import annotations

import math
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that ``quantile_disc`` orders at once.
FEW = 50_000


# Mutations. A table is rewritten as a whole; an operator returns its next state.

def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; columns in ``keep`` stay where new is null."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in cols if c in new.columns])
    j = old.join(n, keys, "full_outer")

    def pick(c):
        if c not in new.columns:
            return F.col(c)
        value = F.coalesce(f"__{c}", c) if c in keep else F.col(f"__{c}")
        return F.when(F.col("__new"), value).otherwise(F.col(c)).alias(c)

    return j.select(*keys, *[pick(c) for c in cols]).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).dropDuplicates(keys).join(old, keys, "left_anti").select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def update_where(df: DataFrame, cond: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in values.items()})


def edit_comment(df: DataFrame, cond: Column, body: Column | None, now: Column) -> DataFrame:
    """A new body and version where ``cond``; without a body the comment is marked deleted."""
    if body is None:
        return update_where(df, cond, deleted_at=now, version=F.col("version") + 1)
    return update_where(df, cond, body=body, version=F.col("version") + 1)


def append_sequence(old: DataFrame, new: DataFrame, key: str, order: str, seq: str = "sequence") -> DataFrame:
    """New rows numbered after the last of their key."""
    last = old.groupBy(key).agg(F.max(seq).alias("__last"))
    n = new.join(last, key, "left").withColumn(seq, F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return old.unionByName(n.drop("__last"), allowMissingColumns=True)


def append_message(threads: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Threads (key, messages array) with new messages (key, at, author, body) at the end;
    threads that don't exist yet are made."""
    add = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "author", "body"))).alias("__add"))
    none = F.array().cast("array<struct<at:timestamp,author:string,body:string>>")
    j = threads.join(add, key, "full_outer")
    return j.select(key, F.concat(F.coalesce("messages", none), F.coalesce("__add", none)).alias("messages"))


def check_integrity(blobs: DataFrame) -> DataFrame:
    """Blobs (content, sha256, size) with ``intact``: what was stored is what is read."""
    return blobs.withColumn("intact", (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size")))


def issues_from_results(results: DataFrame) -> DataFrame:
    """One open issue for each failed or missing result."""
    known = F.col("severity").isin("blocking", "warning", "advisory")
    text = F.concat(F.col("name"), F.lit(": "), F.coalesce(F.nullif("evidence", F.lit("")), F.lit("No evidence provided")))
    return results.filter(F.col("status").isin("failed", "missing")).select(
        "paper_id", F.col("id").alias("rule_id"), "category", F.col("name").alias("title"), text.alias("description"),
        F.when(known, F.col("severity")).otherwise("warning").alias("severity"), "expected", "actual", "advice", F.lit("open").alias("state"),
    )


def copy_table(source: DataFrame, path: str) -> tuple[int, int]:
    """Copies a table and returns both counts, which must agree."""
    source.write.mode("overwrite").parquet(path)
    return source.count(), source.sparkSession.read.parquet(path).count()


# Reads.

def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows one of whose columns contains the query, in any case."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return df.filter(cond)


def where(df: DataFrame, **optional) -> DataFrame:
    """Equality filters; those that are None don't apply."""
    for c, v in optional.items():
        if v is not None:
            df = df.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def keyset_page(df: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """A page in descending order after a cursor, and one row more that tells of a next page.
    Visibility has to be applied to ``df`` before."""
    if after is not None:
        df = df.filter(F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after, strict=True)]))
    return df.orderBy(*[F.desc(c) for c in order]).limit(size + 1)


def quantile_disc(df: DataFrame, column: str, share: float):
    """The smallest value that a share of the rows with a value doesn't exceed; None without rows.

    Exact at any size: sketches only narrow the range that holds it, rows outside are counted,
    and at most FEW rows are ordered.
    """
    c = F.col(column)
    rows = df.select(c).filter(c.isNotNull())
    n = rows.count()
    if n == 0:
        return None
    rank = max(1, math.ceil(share * n))
    while n > FEW:
        at, slack = rank / n, 4 / 10000
        low, high = rows.agg(F.percentile_approx(c, [max(0.0, at - slack), min(1.0, at + slack)], 10000)).first()[0]
        below, within = rows.agg(F.count_if(c < low), F.count_if(c.between(low, high))).first()
        if low == high and below < rank <= below + within:
            return low
        if not below < rank <= below + within or within == n:
            break
        rows, rank, n = rows.filter(c.between(low, high)), rank - below, within
    return rows.orderBy(c).offset(rank - 1).limit(1).first()[0]


def dangling(child: DataFrame, parent: DataFrame, key: str, ref: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(ref).alias(key)), key, "left_anti")


def missing_fields(required: list[str]) -> Column:
    """The names of fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in required]))


def comment_view(comments: DataFrame, viewer: str, chair: bool) -> DataFrame:
    """Comments of each thread in order; deleted bodies are empty, and only chairs see who
    wrote anonymous ones."""
    mine = F.col("author_id") == viewer
    gone = F.col("deleted_at").isNotNull()
    who = F.when(F.lit(chair) | mine | ~F.coalesce("anonymous", F.lit(False)), F.col("author_id"))
    c = F.struct("created_at", "comment_id", F.when(gone, "").otherwise(F.col("body")).alias("body"), who.alias("author"), (mine & ~gone).alias("can_edit"), ((mine | F.lit(chair)) & ~gone).alias("can_delete"))
    return comments.groupBy("thread_id").agg(F.sort_array(F.collect_list(c)).alias("comments"))


def redact(df: DataFrame, allowed: Column, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(allowed, F.col(c)) for c in columns})


def visible_answers(answers: Column, visible: Column) -> Column:
    return F.map_filter(answers, lambda k, v: F.array_contains(visible, k))


# Requests and time.

def first_requests(uploads: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """One upload of each request key, and whether a later one differs from it."""
    w = Window.partitionBy(*keys)
    u = uploads.withColumn("conflict", F.min(payload).over(w) != F.max(payload).over(w))
    return latest(u, keys, F.col(order))


def invitation_status(now: Column) -> Column:
    """The stored status, or expired or invalidated by time and issuer."""
    return F.when(F.col("status") != "pending", F.col("status")).when(F.col("expires_at") <= now, "expired").when(~F.coalesce("issuer_active", F.lit(False)), "invalidated").otherwise("pending")


def rate_limited(hits: DataFrame, keys: list[str], at: str, seconds: int, most: int) -> DataFrame:
    """(keys, hits, windows, rejected): hits beyond ``most`` within a window that begins with its
    first hit.

    A window's start depends on where the one before ended, which no frame expresses: each
    task reads its keys' hits in order of time and holds one window, whatever a key's size.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}

    def run(batches):
        now, row, start, n = None, None, 0, 0
        for pdf in batches:
            done = []
            for *key, t in zip(*[pdf[c] for c in (*keys, "__at")], strict=True):
                if key != now:
                    if row:
                        done.append(row)
                    now, row, start, n = key, [*key, 0, 0, 0], None, 0
                row[-3] += 1
                if start is None or t >= start + seconds * 1_000_000:
                    start, n = t, 0
                    row[-2] += 1
                n += 1
                row[-1] += n > most
            yield pd.DataFrame(done, columns=[*keys, "hits", "windows", "rejected"])
        if row:
            yield pd.DataFrame([row], columns=[*keys, "hits", "windows", "rejected"])

    times = hits.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "hits int, windows int, rejected int"])
    return times.repartition(*keys).sortWithinPartitions(*keys, "__at").mapInPandas(run, schema)


def running_total(df: DataFrame, group: str, order: str, value: str, name: str = "total", chunks: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its group, in the (numeric) order.

    In two levels: boundaries cut a group into chunks, rows are summed within a chunk, and
    the sums of the chunks before are added. So a group with most of the rows is dealt over
    many tasks, and no window holds more than a chunk of it.
    """
    cuts = df.groupBy(group).agg(F.percentile_approx(order, F.array(*[F.lit(i / chunks) for i in range(1, chunks)]), 1000).alias("__cuts")).withColumnRenamed(group, "__g")
    d = df.join(cuts, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("__c", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts", "__g")
    sums = d.groupBy(F.col(group).alias("__g"), F.col("__c").alias("__k")).agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy("__g").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    within = F.sum(value).over(Window.partitionBy(group, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn(name, within)
    j = d.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__c") == F.col("__k")))
    return j.withColumn(name, F.col(name) + F.col("__before")).drop("__c", "__g", "__k", "__before")


def earliest(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The value of the first row of each key."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def is_deadline_open(now: datetime, closes: Column) -> Column:
    return F.coalesce(F.lit(now) < closes, F.lit(True))


def drive_candidates(files: DataFrame, accepted: list[str]) -> DataFrame:
    """Files that can be papers: no folders or shortcuts; documents or accepted extensions."""
    from foliolith.functions.values import FOLDER, GOOGLE_DOC, SHORTCUT, extension

    kind, ext = F.col("mime_type"), F.coalesce(extension(F.col("name")), F.lit(""))
    return files.filter(~kind.isin(FOLDER, SHORTCUT) & ((kind == GOOGLE_DOC) | ext.isin(*[a.lower().lstrip(".") for a in accepted])))
