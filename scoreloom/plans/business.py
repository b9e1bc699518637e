"""The scoring operators over the business tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded
from scoreloom.functions.vocabulary import register_feature
from scoreloom.operators import evaluate
from scoreloom.plans import rules, scoring

for _name, _kind in {
    "customer.balance": "number", "customer.orders": "int", "customer.spend": "number", "customer.ticket": "number",
    "customer.building": "bool", "customer.nation": "int", "customer.segment": "str",
}.items():
    register_feature(_name, _kind)

BALANCE = ((0.0, 0.0), (2500.0, 0.4), (7500.0, 0.9), (9500.0, 1.0))
ORDERS = ((0.0, 0.0), (5.0, 0.5), (15.0, 0.9), (30.0, 1.0))
SPEND = ((0.0, 0.0), (500000.0, 0.5), (4000000.0, 1.0))
TICKET = ((50000.0, 0.0), (150000.0, 0.6), (300000.0, 1.0))
NATION = ((5.0, 0.3), (10.0, 0.6), (20.0, 1.0))
SUBS = {"balance": 0.5, "activity": 0.3, "profile": 0.2}
NAMES = {"customer.balance": "balance", "customer.orders": "orders", "customer.spend": "spend", "customer.ticket": "ticket", "customer.building": "building", "customer.nation": "nation"}


def customer_rules() -> rules.Category:
    band = lambda f, p: {"feature": f, "rule": {"type": "bands", "points": [list(x) for x in p]}}
    return rules.category_of({
        "id": "customers", "subscores": {k: {"weight": w} for k, w in SUBS.items()},
        "inputs": [{"id": "region", "type": "choice", "options": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}, {"id": "segment", "type": "choice", "options": ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]}],
        "signals": [
            {"id": "balance", "subscore": "balance", **band("customer.balance", BALANCE), "suggest": {"text": "raise the balance of {value}", "below": 0.9}},
            {"id": "volume", "subscore": "activity", "weight": 0.6, "any_of": [band("customer.orders", ORDERS), band("customer.spend", SPEND)], "suggest": {"text": "more orders", "text_missing": "first order"}},
            {"id": "ticket", "subscore": "activity", "weight": 0.4, "missing": "exclude", **band("customer.ticket", TICKET), "suggest": {"text": "larger orders"}},
            {"id": "building", "subscore": "profile", "weight": 0.5, "feature": "customer.building", "rule": {"type": "boolean", "true": 1, "false": 0.2}},
            {"id": "nation", "subscore": "profile", "weight": 0.5, "feature": "customer.nation", "rule": {"type": "step", "tiers": [list(x) for x in NATION]}},
        ],
        "eligibility": [
            {"id": "min_balance", "feature": "customer.balance", "min": 0, "level": "fail", "adjust": [{"when": {"segment": ["BUILDING", "MACHINERY"]}, "delta": -500}, {"when": {"region": "ASIA"}, "delta": -300}]},
            {"id": "max_ticket", "feature": "customer.ticket", "max": 160000, "level": "warn", "when_missing": "warn", "adjust_mode": "largest", "adjust": [{"when": {"segment": "BUILDING"}, "delta": -20000}, {"when": {"region": "EUROPE"}, "delta": 30000}]},
            {"id": "building", "feature": "customer.building", "equals": True, "level": "warn", "when_missing": "skip"},
            {"id": "spend", "feature": "customer.spend", "min": 1000000, "level": "fail", "when_missing": "skip"},
        ],
    })


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows from which much is made, dealt over all tasks by key while they are narrow: a file with one row group is read by one task. The number of
    partitions is given, as AQE would merge them by their size before they grow."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def customers(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """Features per customer from orders of over ``least``; without any, orders, spend and ticket are not stated."""
    o = table(spark, d, "orders").where(F.col("o_totalprice") > least).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), rounded(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("spend"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select(
        "c_custkey", F.col("c_acctbal").alias("balance"), "orders", "spend", rounded(F.col("spend") / F.col("orders"), 2).alias("ticket"),
        (F.col("c_mktsegment") == "BUILDING").alias("building"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "region",
    )


CUSTOMERS_SQL = """o AS (SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1),
f AS (SELECT c_custkey, c_acctbal AS balance, orders, spend, round_even(spend / orders, 2) AS ticket, c_mktsegment = 'BUILDING' AS building, c_nationkey AS nation, c_mktsegment AS segment, r_name AS region
  FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def bands_sql(x: str, p: tuple[tuple[float, float], ...]) -> str:
    cases = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {x} <= {p[0][0]} THEN {p[0][1]}::DOUBLE"]
    cases += [f"WHEN {x} <= {b[0]} THEN {a[1]}::DOUBLE + ({b[1]!r}::DOUBLE - {a[1]!r}::DOUBLE) * ((CAST({x} AS DOUBLE) - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE))" for a, b in zip(p, p[1:], strict=False)]
    return f"(CASE {' '.join(cases)} ELSE {p[-1][1]}::DOUBLE END)"


def step_sql(x: str, p: tuple[tuple[float, float], ...], below: float = 0.0) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL {' '.join(f'WHEN {x} >= {a} THEN {y}::DOUBLE' for a, y in reversed(p))} ELSE {below}::DOUBLE END)"


def d4(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


SIGNALS_SQL = f"""{CUSTOMERS_SQL},
s0 AS (SELECT *, round_even({bands_sql("balance", BALANCE)}, 4) AS s_balance, round_even(greatest({bands_sql("orders", ORDERS)}, {bands_sql("spend", SPEND)}), 4) AS s_volume0,
  round_even({bands_sql("ticket", TICKET)}, 4) AS s_ticket, CASE WHEN building THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS s_building, {step_sql("nation", NATION)} AS s_nation FROM f),
s AS (SELECT *, coalesce(s_volume0, 0.0) AS s_volume FROM s0),
sub AS (SELECT *, round_even(CAST({d4("s_balance")} AS DOUBLE) / 1.0 * 100, 1) AS sub_balance,
  round_even(CAST({d4("s_volume")} * {d4("0.6")} + coalesce({d4("s_ticket")} * {d4("0.4")}, 0) AS DOUBLE) / CASE WHEN s_ticket IS NULL THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * 100, 1) AS sub_activity,
  round_even(CAST({d4("s_building")} * {d4("0.5")} + {d4("s_nation")} * {d4("0.5")} AS DOUBLE) / 1.0 * 100, 1) AS sub_profile FROM s),
total AS (SELECT *, round_even(CAST({d4("sub_balance")} * {d4("0.5")} + {d4("sub_activity")} * {d4("0.3")} + {d4("sub_profile")} * {d4("0.2")} AS DOUBLE), 1) AS score FROM sub)"""


def scored(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    return scoring.scored(customers(spark, d, least), customer_rules(), dict(NAMES))


LARGE = 380000.0  # few customers have an order as large, so that many state nothing


def of_large_orders(sql: str) -> str:
    return sql.replace("FROM orders GROUP BY 1", f"FROM orders WHERE o_totalprice > {LARGE} GROUP BY 1")


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, into: dict | None = None, sqls: dict | None = None):
    """Registers a query and, where there is one, its SQL."""

    def keep(f):
        (Q if into is None else into)[name] = f
        if sql:
            (SQL if sqls is None else sqls)[name] = sql
        return f

    return keep


def _rule(kind: str, **k) -> rules.Rule:
    return rules.Rule(kind, **k)


PRICE = ((0.0, 0.0), (50000.0, 0.25), (150000.0, 0.7), (300000.0, 1.0))
SIZE = ((1.0, 1.0), (10.0, 0.8), (25.0, 0.5), (40.0, 0.2), (50.0, 0.0))
QUANTITY = ((5.0, 0.25), (20.0, 0.5), (40.0, 1.0))


@query("rule_bands", f"SELECT o_orderkey, round_even({bands_sql('o_totalprice', PRICE)}, 4) AS score FROM orders")
def rule_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rounded(scoring.rule_score(F.col("o_totalprice"), _rule("bands", points=PRICE)), 4).alias("score"))


@query("rule_bands_decreasing", f"SELECT p_partkey, round_even({bands_sql('p_size', SIZE)}, 4) AS score FROM part")
def rule_bands_decreasing(spark, d):
    return table(spark, d, "part").select("p_partkey", rounded(scoring.rule_score(F.col("p_size"), _rule("bands", points=SIZE)), 4).alias("score"))


@query("rule_step", f"SELECT l_orderkey, l_linenumber, {step_sql('l_quantity', QUANTITY, 0.1)} AS score FROM lineitem")
def rule_step(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.rule_score(F.col("l_quantity"), _rule("step", points=QUANTITY, below=0.1)).alias("score"))


@query("rule_boolean", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS score FROM orders")
def rule_boolean(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scoring.rule_score(F.col("o_orderstatus") == "F", _rule("boolean", no=0.25)).alias("score"))


SOLD = "WITH i AS (SELECT l_suppkey, lower(p_brand) AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT l_suppkey, count(*) FILTER (WHERE b IN ('brand#11','brand#21','brand#31')) AS hits FROM i GROUP BY 1)"
HITS = ((0.0, 0.0), (10.0, 0.5), (80.0, 1.0))


@query("rule_match_count", f"{SOLD} SELECT l_suppkey, hits, round_even({bands_sql('hits', HITS)}, 4) AS score FROM n")
def rule_match_count(spark, d):
    # A supplier's items are an array here, as a document's skills are: some hundred at any size of these tables.
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_list("p_brand").alias("items"))
    values = ("Brand#11", "BRAND#21", "brand#31")
    return items.select("l_suppkey", scoring.match_count(F.col("items"), values).cast("long").alias("hits"), rounded(scoring.rule_score(F.col("items"), _rule("match_count", points=HITS, values=values)), 4).alias("score"))


@query("any_of_best_term", f"WITH {SIGNALS_SQL} SELECT c_custkey, s_volume AS score, CASE WHEN s_volume0 IS NULL THEN NULL WHEN {bands_sql('orders', ORDERS)} >= {bands_sql('spend', SPEND)} THEN 'customer.orders' ELSE 'customer.spend' END AS feature FROM s")
def any_of_best_term(spark, d):
    s = scored(spark, d).select("c_custkey", F.col("signals")[1].alias("v"))
    return s.select("c_custkey", F.col("v.score").cast("double").alias("score"), F.col("v.feature").alias("feature"))


@query("missing_zero_vs_exclude", of_large_orders(f"WITH {SIGNALS_SQL} SELECT c_custkey, orders, s_volume AS zero_score, s_ticket AS exclude_score, sub_activity, score FROM total"))
def missing_zero_vs_exclude(spark, d):
    return scored(spark, d, LARGE).select("orders", "score", "c_custkey", F.col("signals")[1]["score"].cast("double").alias("zero_score"), F.col("signals")[2]["score"].cast("double").alias("exclude_score"), "sub_activity")


@query("nominal_weights", "SELECT * FROM (VALUES ('balance', 0.5::DOUBLE), ('volume', 0.18), ('ticket', 0.12), ('building', 0.1), ('nation', 0.1)) AS t(signal, nominal)")
def nominal_weights(spark, d):
    _, signals, _ = scoring.rule_tables(spark, [customer_rules()])
    return signals.select("signal", rounded("nominal", 4).alias("nominal"))


@query("subscore_rollup", f"WITH {SIGNALS_SQL} SELECT c_custkey, sub_balance, sub_activity, sub_profile FROM sub")
def subscore_rollup(spark, d):
    return scored(spark, d).select("c_custkey", "sub_balance", "sub_activity", "sub_profile")


@query("overall_rollup", f"WITH {SIGNALS_SQL} SELECT c_custkey, score FROM total")
def overall_rollup(spark, d):
    return scored(spark, d).select("c_custkey", "score")


def long_features(spark, d) -> DataFrame:
    c = customers(spark, d)
    number = lambda f, x: F.struct(F.lit(f).alias("feature"), F.col(x).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("array<string>").alias("items"))
    flag = F.struct(F.lit("customer.building").alias("feature"), F.lit(None).cast("double").alias("num"), F.col("building").alias("bool"), F.lit(None).cast("array<string>").alias("items"))
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*[number(f, x) for f, x in NAMES.items() if x != "building"], flag)).alias("r")).select("doc_id", "r.*")
    return rows.where("num is not null or bool is not null or items is not null")


@query("overall_by_tables", f"WITH {SIGNALS_SQL} SELECT c_custkey, score, round_even(CAST(CASE WHEN balance <> 0 THEN 0.5 ELSE 0 END + CASE WHEN orders IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN building THEN 0.1 ELSE 0 END + CASE WHEN nation <> 0 THEN 0.1 ELSE 0 END AS DOUBLE), 2) AS confidence FROM total")
def overall_by_tables(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("customers").alias("category"))
    return scoring.scored_by_tables(long_features(spark, d), docs, [customer_rules()]).select(F.col("doc_id").alias("c_custkey"), "score", "confidence")


@query("confidence", SQL["overall_by_tables"].replace("score, round_even", "round_even"))
def confidence(spark, d):
    return scored(spark, d).select("c_custkey", "confidence")


@query("inputs_override", f"WITH {SIGNALS_SQL}, g AS (SELECT *, CASE WHEN region = 'ASIA' THEN 5000.0 END AS given FROM f) SELECT c_custkey, coalesce(given, balance) AS balance, CASE WHEN segment NOT IN ('BUILDING','AUTOMOBILE') THEN 'segment' END AS input_error FROM g")
def inputs_override(spark, d):
    base = rules.category_of({
        "id": "inputs", "subscores": {"a": {"weight": 1}}, "signals": [{"id": "b", "subscore": "a", "feature": "customer.balance", "rule": {"type": "bands", "points": [[0, 0], [1, 1]]}}],
        "inputs": [{"id": "segment", "type": "choice", "options": ["BUILDING", "AUTOMOBILE"]}, {"id": "funds", "type": "number", "feature": "customer.balance"}],
    })
    c = customers(spark, d).withColumn("given", F.when(F.col("region") == "ASIA", 5000.0))
    return scoring.with_inputs(c, base, dict(NAMES), {"segment": "segment", "funds": "given"}).select("c_custkey", "balance", "input_error")


SUMS = "(CASE WHEN segment IN ('BUILDING','MACHINERY') THEN -500.0 ELSE 0.0 END + CASE WHEN region = 'ASIA' THEN -300.0 ELSE 0.0 END)"
LARGEST = "(CASE WHEN region = 'EUROPE' THEN 30000.0 WHEN segment = 'BUILDING' THEN -20000.0 ELSE 0.0 END)"
GATES_SQL = f"""{CUSTOMERS_SQL}, g AS (
SELECT c_custkey, 'min_balance' AS gate, CASE WHEN balance IS NULL THEN 'unknown' WHEN balance >= {SUMS} THEN 'pass' ELSE 'fail' END AS status, balance AS value, CAST({SUMS} AS DOUBLE) AS lim FROM f
UNION ALL SELECT c_custkey, 'max_ticket', CASE WHEN ticket IS NULL THEN 'warn' WHEN ticket <= 160000 + {LARGEST} THEN 'pass' ELSE 'warn' END, ticket, CAST(160000 + {LARGEST} AS DOUBLE) FROM f
UNION ALL SELECT c_custkey, 'building', CASE WHEN building THEN 'pass' ELSE 'warn' END, CAST(building AS DOUBLE), NULL FROM f
UNION ALL SELECT c_custkey, 'spend', CASE WHEN spend >= 1000000 THEN 'pass' ELSE 'fail' END, spend, 1000000.0 FROM f WHERE spend IS NOT NULL)"""


def gate_rows(spark, d, least: float = 0.0) -> DataFrame:
    g = scoring.gated(customers(spark, d, least), customer_rules(), dict(NAMES), {"segment": F.col("segment"), "region": F.col("region")})
    return g.select("c_custkey", "eligible", F.explode("gates").alias("g")).select("c_custkey", "eligible", "g.gate", "g.status", "g.value", F.col("g.limit").alias("lim"))


@query("gate_min_max_equals", f"WITH {GATES_SQL} SELECT c_custkey, gate, status, value, lim FROM g")
def gate_min_max_equals(spark, d):
    return gate_rows(spark, d).select("c_custkey", "gate", "status", "value", "lim")


@query("gate_missing_modes", of_large_orders(f"WITH {GATES_SQL} SELECT gate, status, count(*) AS n, count(value) AS stated FROM g GROUP BY 1, 2"))
def gate_missing_modes(spark, d):
    return gate_rows(spark, d, LARGE).groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("stated"))


@query("gate_adjust_sum", f"WITH {GATES_SQL} SELECT c_custkey, lim, status FROM g WHERE gate = 'min_balance'")
def gate_adjust_sum(spark, d):
    return gate_rows(spark, d).where("gate = 'min_balance'").select("c_custkey", "lim", "status")


@query("gate_adjust_largest", f"WITH {GATES_SQL} SELECT c_custkey, lim, status FROM g WHERE gate = 'max_ticket'")
def gate_adjust_largest(spark, d):
    return gate_rows(spark, d).where("gate = 'max_ticket'").select("c_custkey", "lim", "status")


@query("eligibility", f"WITH {GATES_SQL} SELECT c_custkey, NOT bool_or(status = 'fail') AS eligible FROM g GROUP BY 1")
def eligibility(spark, d):
    g = scoring.gated(customers(spark, d), customer_rules(), dict(NAMES), {"segment": F.col("segment"), "region": F.col("region")})
    return g.select("c_custkey", "eligible")


SUGGEST_SQL = f"""{SIGNALS_SQL}, a AS (
SELECT c_custkey, 'balance' AS signal, round_even(greatest(0.0, 1.0 - s_balance) * 0.5 * 100, 1) AS points, 0 AS so FROM s WHERE s_balance < 0.9
UNION ALL SELECT c_custkey, 'volume', round_even(greatest(0.0, 1.0 - s_volume) * 0.18 * 100, 1), 1 FROM s WHERE s_volume0 IS NULL OR s_volume < 0.7
UNION ALL SELECT c_custkey, 'ticket', round_even(greatest(0.0, 1.0 - s_ticket) * 0.12 * 100, 1), 2 FROM s WHERE s_ticket < 0.7),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY points DESC, so) AS INTEGER) AS rank FROM a WHERE points > 0)"""


def advice(spark, d) -> DataFrame:
    return scoring.suggestions(scored(spark, d), customer_rules(), dict(NAMES), "c_custkey")


@query("suggestions_ranked", f"WITH {SUGGEST_SQL} SELECT c_custkey, signal, points, rank FROM r")
def suggestions_ranked(spark, d):
    return advice(spark, d).select("c_custkey", "signal", "points", "rank")


@query("impact_bucket", f"WITH {SUGGEST_SQL} SELECT CASE WHEN points >= 6.0 THEN 'high' WHEN points >= 2.5 THEN 'medium' ELSE 'low' END AS impact, count(*) AS n FROM r GROUP BY 1")
def impact_bucket(spark, d):
    return advice(spark, d).groupBy("impact").agg(F.count(F.lit(1)).alias("n"))


LEVEL_SQL = "CASE " + " ".join(f"WHEN score >= {a} THEN '{b}'" for a, b in scoring.LEVELS) + " END"


@query("score_band", f"WITH {SIGNALS_SQL} SELECT {LEVEL_SQL} AS level, count(*) AS n FROM total GROUP BY 1")
def score_band(spark, d):
    return scored(spark, d).groupBy(scoring.level(F.col("score")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("overall_blend", f"WITH {SIGNALS_SQL} SELECT c_custkey, CASE WHEN orders IS NOT NULL THEN round_even(CAST({d4('score')} * 0.5 + {d4('sub_activity')} * 0.3 + {d4('sub_profile')} * 0.2 AS DOUBLE), 1) END AS overall FROM total")
def overall_blend(spark, d):
    s = scored(spark, d)
    return s.select("c_custkey", scoring.blend(F.col("score"), F.when(F.col("orders").isNotNull(), F.col("sub_activity")), F.col("sub_profile")).alias("overall"))


TOP_SQL = f"""WITH {SUGGEST_SQL}, g0 AS (SELECT c_custkey, 'profile' AS source, 'profile' AS what, round_even((100 - sub_profile) * 0.2, 1) AS points FROM sub),
g1 AS (SELECT c_custkey, 'activity' AS source, 'activity' AS what, round_even((100 - sub_activity) * 0.3, 1) AS points FROM sub),
u AS (SELECT c_custkey, 'strength' AS source, signal AS what, round_even(points * 0.5, 1) AS points FROM r UNION ALL SELECT * FROM g0 UNION ALL SELECT * FROM g1),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY points DESC, source, what) AS INTEGER) AS rank FROM u WHERE points > 0)
SELECT c_custkey, source, what, points, rank FROM t WHERE rank <= 6"""


@query("top_fixes_union", TOP_SQL)
def top_fixes_union(spark, d):
    s = scored(spark, d)
    one = lambda source, x, share: s.select("c_custkey", F.lit(source).alias("source"), F.lit(source).alias("what"), rounded((100 - F.col(x)) * share, 1).alias("points"))
    a = scoring.suggestions(s, customer_rules(), dict(NAMES), "c_custkey").select("c_custkey", F.lit("strength").alias("source"), F.col("signal").alias("what"), rounded(F.col("points") * 0.5, 1).alias("points"))
    every = a.unionByName(one("profile", "sub_profile", 0.2)).unionByName(one("activity", "sub_activity", 0.3))
    return evaluate.top_per_key(every.where("points > 0"), "c_custkey", "points", ["source", "what"])


def _supplier(spark, d, until: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") < until)
    return li.groupBy("l_suppkey").agg(rounded(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 1).alias("strength"))


def _supplier_sql(until: str) -> str:
    return f"SELECT l_suppkey, round_even(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 1) AS strength FROM lineitem WHERE l_shipdate < TIMESTAMP '{until}' GROUP BY 1"


@query("snapshot_diff", f"""WITH a AS ({_supplier_sql("1995-01-01")}), b AS ({_supplier_sql("1998-01-01")})
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN a.l_suppkey IS NULL THEN 'new' WHEN b.l_suppkey IS NULL THEN 'removed' ELSE 'moved' END AS change, 'strength' AS field, a.strength AS before, b.strength AS after
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey WHERE a.l_suppkey IS NULL OR b.l_suppkey IS NULL OR abs(a.strength - b.strength) > 0.5""")  # fmt: skip
def snapshot_diff(spark, d):
    return evaluate.snapshot_diff(_supplier(spark, d, "1995-01-01"), _supplier(spark, d, "1998-01-01"), "l_suppkey", ["strength"], 0.5)


@query("derived_features", """SELECT o_orderkey, CAST(date_diff('year', CAST(o_orderdate AS DATE), DATE '2026-09-22') - CASE WHEN (month(o_orderdate), day(o_orderdate)) > (9, 22) THEN 1 ELSE 0 END AS INTEGER) AS age,
round_even(CASE WHEN o_custkey % 11 > 0 THEN least(1.0::DOUBLE, (o_custkey % 7 + o_custkey % 3) / (o_custkey % 11)) END, 4) AS share, round_even(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 100 ELSE (o_custkey % 10) * 9.5 END, 1) AS pct, CAST(2026 - year(o_orderdate) AS INTEGER) AS years_since FROM orders""")  # fmt: skip
def derived_features(spark, d):
    from scoreloom.functions import derived

    o, k = table(spark, d, "orders"), F.col("o_custkey")
    today = F.to_date(F.lit("2026-09-22"))
    return o.select(
        "o_orderkey", derived.age(F.to_date("o_orderdate"), today).alias("age"),
        rounded(derived.share((k % 7).cast("double"), (k % 3).cast("double"), (k % 11).cast("double")), 4).alias("share"),
        derived.percent_estimate(F.when(k % 2 == 0, (k % 100).cast("double")), (k % 10).cast("double")).alias("pct"), derived.years_since(F.year("o_orderdate"), today).alias("years_since"),
    )


# Labels say which documents have 1,500 characters or more, and how many; of every tenth document nothing was found.
LONG_TEXT = "CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END"
FIELDS = f"""f AS (SELECT lang, (quality = 1) = (n_chars >= 1500 AND doc_id % 10 > 0) AS a, doc_id % 10 > 0 AS b FROM labels JOIN documents USING (doc_id)),
u AS (SELECT lang, a AS ok FROM f UNION ALL SELECT lang, b FROM f)"""


def label_fields(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, features, kinds): two labelled features per document, a flag and a number that may be a little off."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    none = F.lit(None).cast("array<string>")
    both = lambda flag, n: F.explode(F.array(F.struct(F.lit("long").alias("feature"), F.lit(None).cast("double").alias("num"), flag.alias("bool"), none.alias("items")), F.struct(F.lit("chars").alias("feature"), n.cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"), none.alias("items"))))
    labelled = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", both(F.col("quality") == 1, F.col("n_chars") + 0.04).alias("v")).select("doc_id", "lang", "v.*")
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").where(F.col("doc_id") % 10 > 0)
    found = known.select("doc_id", both(F.col("n_chars") >= 1500, F.col("n_chars")).alias("v")).select("doc_id", "v.*")
    every_tenth = table(spark, d, "labels").where(F.col("doc_id") % 10 == 0).select("doc_id", F.lit("long").alias("feature"), F.lit(None).cast("double").alias("num"), F.lit(False).alias("bool"), none.alias("items"))
    kinds = spark.createDataFrame([("long", "bool"), ("chars", "number")], "feature string, kind string")
    return labelled, found.unionByName(every_tenth), kinds


@query("label_accuracy", f"WITH {FIELDS} SELECT count(*) AS fields, CAST(sum(ok::INT) AS BIGINT) AS correct, round_even(avg(ok::INT::DOUBLE), 4) AS accuracy FROM u")
def label_accuracy(spark, d):
    a = evaluate.accuracy(*label_fields(spark, d), "lang").where("level = 1")
    return a.select("fields", F.col("right").alias("correct"), rounded(F.col("right") / F.col("fields"), 4).alias("accuracy"))


@query("accuracy_rollup", f"WITH {FIELDS} SELECT lang, count(*) AS fields, CAST(sum(ok::INT) AS BIGINT) AS correct FROM u GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, d):
    return evaluate.accuracy(*label_fields(spark, d), "lang").select("lang", "fields", F.col("right").alias("correct"))


@query("tier_order_pivot", """WITH t AS (SELECT lang, max(n_chars) FILTER (WHERE quality = 0) AS low_max, min(n_chars) FILTER (WHERE quality = 1) AS high_min FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, CAST(low_max AS DOUBLE) AS low_max, CAST(high_min AS DOUBLE) AS high_min, low_max < high_min AS ordered FROM t""")
def tier_order_pivot(spark, d):
    e = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("tier", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return evaluate.tier_order(e, "lang", "tier", "n_chars", ["high", "low"]).select("lang", "low_max", "high_min", "ordered")


@query("tier_bands", """SELECT lang, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS tier, count(*) AS cases, count(*) FILTER (WHERE CASE WHEN quality = 1 THEN n_chars < 800 ELSE n_chars > 2000 END) AS outside FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def tier_bands(spark, d):
    e = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("tier", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return evaluate.outside_bands(e, ["lang", "tier"], "tier", "n_chars", {"high": (800, None), "low": (None, 2000)})


@query("threshold_sweep", "SELECT t AS threshold, round_even(avg((value >= t)::INT::DOUBLE) FILTER (WHERE event_type = 'purchase'), 4) AS tpr, round_even(avg((value >= t)::INT::DOUBLE) FILTER (WHERE event_type <> 'purchase'), 4) AS fpr FROM events, (VALUES (10.0::DOUBLE), (50.0), (100.0)) AS x(t) GROUP BY t")
def threshold_sweep(spark, d):
    e = table(spark, d, "events").withColumn("p", F.col("event_type") == "purchase")
    return evaluate.threshold_sweep(e, "value", "p", [10, 50, 100])


@query("index_quantiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE r = least(floor(0.1 * n), n - 1)) AS p10, max(value) FILTER (WHERE r = least(floor(0.5 * n), n - 1)) AS median, max(value) FILTER (WHERE r = least(floor(0.9 * n), n - 1)) AS p90 FROM r GROUP BY 1""")  # fmt: skip
def index_quantiles(spark, d):
    return evaluate.index_quantile(table(spark, d, "events"), "event_type", "value", {"p10": 0.1, "median": 0.5, "p90": 0.9})


def suggestion_texts_sql() -> str:
    return f"WITH {SUGGEST_SQL} SELECT c_custkey, 'raise the balance of ' || CASE WHEN balance = floor(balance) THEN CAST(CAST(balance AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', balance), '\\.?0+$', '') END AS text FROM r JOIN f USING (c_custkey) WHERE signal = 'balance'"
