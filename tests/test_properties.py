"""Random small tables against plain Python."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from verisift.functions.rules import Rule
from verisift.operators.checks import check
from verisift.operators.profile import profile
from verisift.operators.rejects import rejects

ROWS = st.lists(
    st.tuples(
        st.one_of(st.none(), st.sampled_from(["", " ", "a", "b", "abc", "12", "1.5", "é"])),
        st.one_of(st.none(), st.integers(-5, 5)),
    ),
    max_size=25,
)
RULES = [
    Rule("null", "not_null", "s"), Rule("len", "length_check", "s", params={"min_length": 1, "max_length": 2}),
    Rule("dom", "domain_check", "s", params={"allowed_values": ["a", "b"]}),
    Rule("rng", "range_check", "n", params={"min_value": -2, "max_value": 3}),
    Rule("txt", "range_check", "s", params={"max_value": 2}),
    Rule("uni", "uniqueness", "s"), Rule("pair", "uniqueness", "s", params={"columns": ["s", "n"]}),
    Rule("typ", "data_type", "s", params={"expected_type": "integer"}),
    Rule("if", "conditional", "s", params={
        "condition_column": "n", "condition_operator": "greater_than", "condition_value": 0, "then_rule_type": "not_null"}),
]


def expected(rows):
    s_counts, pairs = Counter(r[0] for r in rows), Counter(rows)
    blank = lambda s: s is None or s.strip() == ""
    return {
        "null": sum(blank(s) for s, _ in rows),
        "len": sum(s is not None and not 1 <= len(s) <= 2 for s, _ in rows),
        "dom": sum(s is not None and s not in ("a", "b") for s, _ in rows),
        "rng": sum(n is not None and not -2 <= n <= 3 for _, n in rows),
        "txt": sum(s == "12" for s, _ in rows),
        "uni": sum(c for c in s_counts.values() if c > 1),
        "pair": sum(c for c in pairs.values() if c > 1),
        "typ": sum(s is not None and s != "12" for s, _ in rows),
        "if": sum(n is not None and n > 0 and blank(s) for s, n in rows),
    }


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_counts_and_rejects_match_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "s string, n int")
    found = {r["rule_id"]: r for r in check(df, RULES, dataset_id="d", run_id="r").collect()}
    want = expected(rows)
    assert {k: r["failed_records"] for k, r in found.items()} == want
    assert all(r["passed_records"] + r["failed_records"] == len(rows) for r in found.values())
    for sample in (3, None):
        got = Counter(r["rule_id"] for r in rejects(df, RULES, dataset_id="d", run_id="r", sample=sample).collect())
        assert dict(got) == {k: v if sample is None else min(v, sample) for k, v in want.items() if v}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_profile_matches_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "s string, n int")
    got = {r["column_name"]: r for r in profile(df).collect()}
    for i, name in enumerate(("s", "n")):
        values = [r[i] for r in rows if r[i] is not None]
        assert (got[name]["non_null_count"], got[name]["distinct_count"]) == (len(values), len(set(values)))
    texts = Counter(r[0] for r in rows if r[0] is not None)
    top = sorted(texts.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:10]
    assert [(e["value"], e["count"]) for e in got["s"]["top_values"]] == top


def test_wide_table_is_profiled_in_chunks(spark):
    from verisift.operators.profile import column_stats
    df = spark.range(3).selectExpr(*[f"id + {i} as c{i}" for i in range(130)])
    rows = {r["column_name"]: r for r in profile(df).collect()}
    assert len(rows) == 130 and all(r["distinct_count"] == 3 and r["row_count"] == 3 for r in rows.values())
    assert rows["c129"]["max_value"] == "131"
    assert column_stats(df).count() == 130


def test_discrete_quantiles_of_sorted_parts(spark):
    from pyspark.sql import functions as F
    from verisift.operators.skew import discrete_quantile
    rows = [(f"g{k % 3}", None if k % 11 == 0 else float(k * 37 % 501 - 250), k % 7 + 1) for k in range(900)]
    rows += [("few", 1.0, 1), ("few", 2.0, 1), ("hot", 5.0, 10**6), ("hot", 4.0, 1), ("none", None, 4), (None, 3.0, 2)]
    df = spark.createDataFrame(rows, "of string, v double, n long")
    counts = df.groupBy("of", "v").agg(F.sum("n").alias("__n"))
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        want = {}
        for name in {r[0] for r in rows}:
            values = sorted((v, n) for of, v, n in rows if of == name and v is not None)
            total, upto = sum(n for _, n in values), 0
            for v, n in values:
                upto += n
                if upto >= max(1, q * total):
                    want[name] = v
                    break
        assert {r["of"]: r["quantile"] for r in discrete_quantile(counts, "of", "v", q).collect()} == want


def test_no_task_holds_all_values(spark, sf_dir):
    from verisift.queries import catalog
    states = catalog.QUERIES["metric_states"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in states


def test_readers_sum_up_no_records(spark, sf_dir):
    from verisift.queries import rules
    for name in ("rejects_default", "rejects_without_keys"):
        plan = rules.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "distinct" not in plan.lower()
