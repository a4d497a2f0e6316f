"""Queries of the submission and review workflow over the driver's tables: orders are
submissions, customers users, nations conferences, events the event log, conversations threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolith.functions import values as V
from foliolith.operators import decisions, portal
from foliolith.operators import relational as R
from foliolith.session import table as t


def members(s, sf):
    c = t(s, sf, "customer")
    role = F.when(F.col("c_custkey") % 50 == 0, "owner").when(F.col("c_custkey") % 5 == 0, "reviewer").otherwise("author")
    return c.select(F.col("c_nationkey").alias("conference_id"), F.col("c_custkey").alias("user_id"), role.alias("role"))


_MODEL = """mem AS (SELECT c_nationkey AS conference_id, c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'owner' WHEN c_custkey % 5 = 0 THEN 'reviewer' ELSE 'author' END AS role FROM customer)"""


def upsert(s, sf):
    c = t(s, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    new = c.filter("c_custkey % 7 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, 99).cast("int").alias("c_nationkey"))
    return R.upsert(c, new, ["c_custkey"], keep=["c_nationkey"])


def sequence(s, sf):
    o = t(s, sf, "orders")
    old = R.numbered(o.filter("o_orderkey % 2 = 0"), ["o_custkey"], F.col("o_orderkey"), name="sequence").select("o_custkey", "o_orderkey", "sequence")
    new = o.filter("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey")
    return R.append_sequence(old, new, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.col("sequence").cast("bigint").alias("sequence"))


def comments(s, sf):
    c = t(s, sf, "conversations")
    view = R.comment_view(c.select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("created_at"), F.col("turn").alias("comment_id"), F.col("text").alias("body"), F.col("role").alias("author_id"),
        F.when(F.col("turn") % 3 == 2, F.lit(1)).alias("deleted_at"), (F.col("turn") % 2 == 1).alias("anonymous")), "user", False)
    x = view.select("thread_id", F.explode("comments").alias("c"))
    return x.select("thread_id", F.col("c.comment_id").alias("turn"), F.length("c.body").alias("chars"), F.col("c.author").alias("author"), F.col("c.can_edit").alias("can_edit"))


def page(s, sf, after=None):
    o = t(s, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderdate", "o_orderkey", "o_custkey")
    return R.keyset_page(o, ["o_orderdate", "o_orderkey"], 100, after)


def second_page(s, sf):
    """The page after the row with the median key: cursor values are few, not data."""
    key = R.quantile_disc(t(s, sf, "orders"), "o_orderkey", 0.5)
    at = t(s, sf, "orders").filter(F.col("o_orderkey") == key).select("o_orderdate", "o_orderkey").first()
    return page(s, sf, (at[0], at[1]))




def rate_limit(s, sf):
    return R.rate_limited(t(s, sf, "events"), ["user_id"], "ts", 3600, 2)


def invitations(s, sf):
    e = t(s, sf, "events")
    last = F.lit("2024-01-15").cast("timestamp")
    i = e.select("event_id", F.when(F.col("event_id") % 4 == 0, "accepted").otherwise("pending").alias("status"), F.col("ts").alias("expires_at"), (F.col("event_id") % 3 == 0).alias("issuer_active"))
    return i.select(R.invitation_status(last).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def first_requests(s, sf):
    o = t(s, sf, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderpriority").alias("request_key"), "o_orderkey", F.col("o_orderstatus").alias("payload"))
    return R.first_requests(o, ["paper", "request_key"], "o_orderkey", "payload").select("paper", "request_key", "o_orderkey", "conflict")


def threads(s, sf):
    c = t(s, sf, "conversations")
    old = c.filter("turn = 0").select("conv_id", F.array(F.struct(F.timestamp_seconds("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body"))).alias("messages")).filter("conv_id % 2 = 0")
    new = c.filter("turn > 0").select("conv_id", F.timestamp_seconds("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body"))
    return R.append_message(old, new, "conv_id").select("conv_id", F.size("messages").cast("bigint").alias("n"), F.element_at("messages", -1)["author"].alias("last_author"))


QUERIES = {
    "j11_enrich_latest": (lambda s, sf: t(s, sf, "customer").join(R.latest(t(s, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").select("c_custkey", "o_orderkey"), "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "j14_dangling": (lambda s, sf: R.dangling(t(s, sf, "orders"), t(s, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "k1_upsert": (upsert, "WITH n AS (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 2 = 0 THEN 99 END AS nk FROM customer WHERE c_custkey % 7 = 0) SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment, CASE WHEN k IS NULL THEN c_nationkey ELSE coalesce(nk, c_nationkey) END::INT AS c_nationkey FROM customer FULL JOIN n ON c_custkey = k"),
    "k4_insert_ignore": (lambda s, sf: R.insert_ignore(t(s, sf, "nation").filter("n_nationkey < 10").select("n_nationkey", "n_name"), t(s, sf, "nation").filter("n_nationkey > 5").select("n_nationkey", F.lower("n_name").alias("n_name")), ["n_nationkey"]), "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN n_name ELSE lower(n_name) END AS n_name FROM nation"),
    "k5_sequence": (sequence, "WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS r, count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) AS e FROM orders) SELECT o_custkey, o_orderkey, (r + CASE WHEN o_orderkey % 2 = 1 THEN e ELSE 0 END)::BIGINT AS sequence FROM a"),
    "k7_delete": (lambda s, sf: R.delete(t(s, sf, "supplier"), t(s, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("int").alias("s_nationkey")), ["s_nationkey"]).select("s_suppkey", "s_name"), "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "k13_update": (lambda s, sf: R.update_where(t(s, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 3 == 0, o_orderstatus=F.lit("X")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "k14_threads": (threads, "SELECT conv_id, count(*) FILTER (turn > 0 OR conv_id % 2 = 0) AS n, arg_max(role, turn) FILTER (turn > 0 OR conv_id % 2 = 0) AS last_author FROM conversations GROUP BY 1 HAVING n > 0"),
    "q2_search": (lambda s, sf: R.search(t(s, sf, "part"), "AL", "p_name", "p_type").select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')"),
    "q4_filters": (lambda s, sf: R.where(t(s, sf, "orders"), o_orderstatus=["O", "F"], o_orderpriority=None, o_custkey=7).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey = 7"),
    "q9_roles": (lambda s, sf: members(s, sf).filter(V.role_at_least(F.col("role"), "reviewer")).groupBy("conference_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "owner").alias("owners")), f"WITH {_MODEL} SELECT conference_id, count(*) AS n, count(*) FILTER (role = 'owner') AS owners FROM mem WHERE role IN ('owner', 'reviewer') GROUP BY 1"),
    "q10_redact": (lambda s, sf: R.redact(t(s, sf, "customer"), F.col("c_nationkey") < 5, "c_name", "c_acctbal").select("c_custkey", "c_name"), "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name END AS c_name FROM customer"),
    "q13_gaps": (lambda s, sf: t(s, sf, "part").withColumn("a", F.when(F.col("p_size") > 10, F.col("p_name"))).withColumn("b", F.when(F.col("p_partkey") % 2 == 0, " ")).select("p_partkey", F.array_join(R.missing_fields(["a", "b", "p_type"]), ",").alias("gaps")), "SELECT p_partkey, CASE WHEN p_size > 10 THEN 'b' ELSE 'a,b' END AS gaps FROM part"),
    "q15_comments": (comments, "SELECT conv_id AS thread_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE length(text) END::INT AS chars, CASE WHEN role = 'user' OR turn % 2 = 0 THEN role END AS author, role = 'user' AND turn % 3 <> 2 AS can_edit FROM conversations"),
    "o4_latest": (lambda s, sf: R.latest(t(s, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id"), "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"),
    "o6_first_page": (page, "SELECT o_orderdate, o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY 1 DESC, 2 DESC LIMIT 101"),
    "o9_numbers": (lambda s, sf: R.numbered(t(s, sf, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", F.col("number").cast("bigint").alias("number")), "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders"),
    "w11_first_requests": (first_requests, "SELECT o_custkey AS paper, o_orderpriority AS request_key, min(o_orderkey) AS o_orderkey, min(o_orderstatus) <> max(o_orderstatus) AS conflict FROM orders GROUP BY 1, 2"),
    "w12_invitations": (invitations, "SELECT CASE WHEN event_id % 4 = 0 THEN 'accepted' WHEN ts <= TIMESTAMP '2024-01-15' THEN 'expired' WHEN event_id % 3 <> 0 THEN 'invalidated' ELSE 'pending' END AS status, count(*) AS n FROM events GROUP BY 1"),
    "o1_order": (lambda s, sf: portal.newest_first(t(s, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey").limit(50), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"),
    "o5_earliest": (lambda s, sf: R.earliest(t(s, sf, "lineitem"), ["l_suppkey"], "l_orderkey", "l_shipdate", "l_orderkey"), "SELECT l_suppkey, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1"),
    "o6_second_page": (second_page, """WITH k AS (SELECT quantile_disc(o_orderkey, 0.5) AS k FROM orders), a AS (SELECT o_orderdate AS d, o_orderkey AS n FROM orders JOIN k ON o_orderkey = k)
SELECT o_orderdate, o_orderkey, o_custkey FROM orders, a WHERE o_orderstatus <> 'P' AND (o_orderdate, o_orderkey) < (d, n) ORDER BY 1 DESC, 2 DESC LIMIT 101"""),
    "a10_next_number": (lambda s, sf: decisions.next_number(t(s, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(t(s, sf, "orders"), "o_custkey", "left"), ["o_custkey"], "o_orderkey"), "SELECT c_custkey AS o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "w13_rate_limit": (rate_limit, """WITH RECURSIVE w(user_id, start) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 3600 SECOND) FROM w WHERE w.start IS NOT NULL),
c AS (SELECT w.user_id, w.start, (SELECT count(*) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.start AND e.ts < w.start + INTERVAL 3600 SECOND) AS n FROM w WHERE w.start IS NOT NULL)
SELECT user_id, sum(n)::INT AS hits, count(*)::INT AS windows, sum(greatest(0, n - 2))::INT AS rejected FROM c GROUP BY 1"""),
}
