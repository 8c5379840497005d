"""Queries of normalisation, blocking, comparison features and anchors over source_a and source_b."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalise as N
from kinfold.functions import similarity as S
from kinfold.operators.blocking import AllOf, AnyOf, DateWindow, Exact, Prefix, block_join, candidate_diagnostics, candidate_pairs, random_pairs, unique_keys
from kinfold.operators.features import Anchor, Comparison, anchor_conflicts, anchor_evidence, comparison_features
from kinfold.session import Scratch, read_table

DATES = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]


def latest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row per record: that of its newest load, as a combining aggregate."""
    rows = read_table(spark, sf_dir, name)
    age = F.struct(-F.col("load_id"), F.coalesce(-F.unix_micros("updated_at"), F.lit(2**63 - 1)), *[F.coalesce(c, F.lit("")) for c in ("label_value", "date_value", "group_value")])
    return rows.groupBy("record_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "record_key"]), age).alias("x")).select("record_key", "x.*")


def label_norm(x):
    return N.blank_to_null(F.lower(N.collapse_whitespace(x)))


def group_norm(x):
    bare = F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return F.when(bare != "", bare)


def prepared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = latest(spark, sf_dir, name)
    return rows.select("record_key", label_norm(F.col("label_value")).alias("v_label"), N.parse_date(F.col("date_value"), DATES).alias("v_date"), group_norm(F.col("group_value")).alias("v_group"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return prepared(spark, sf_dir, "source_a"), prepared(spark, sf_dir, "source_b")


RULES = {"date_initial": AllOf((Exact("date"), Prefix("label", 1))), "group_prefix": AllOf((Exact("group"), Prefix("label", 3)))}
BLOCKS = {
    "block_exact": {"date": Exact("date")},
    "block_prefix": {"label": Prefix("label", 6)},
    "block_date_window": {"window": DateWindow("date", 2)},
    "block_all": {"all": AllOf((Exact("group"), Prefix("label", 2), DateWindow("date", 30)))},
    "block_any": {"any": AnyOf((Prefix("label", 8), AllOf((Exact("date"), Exact("group")))))},
}
COMPARISONS = [
    Comparison("label", "label", "levenshtein", (("missing",), ("exact",), ("threshold", 0.9), ("threshold", 0.75), ("else",))),
    Comparison("gram", "label", "qgram", (("missing",), ("exact",), ("threshold", 0.6), ("else",)), {"q": 2}),
    Comparison("date", "date", "date_difference", (("missing",), ("exact",), ("maximum_difference", 2.0), ("maximum_difference", 31.0), ("else",))),
    Comparison("group", "group", "exact", (("missing",), ("exact",), ("else",))),
]
ANCHORS = [
    Anchor("label_date", AllOf((Exact("label"), Exact("date")))),
    Anchor("label_group", AllOf((Exact("label"), Exact("group"))), True, False),
    Anchor("near_date", AllOf((Prefix("label", 5), DateWindow("date", 1))), False, False),
]


def _block(rules):
    return lambda spark, sf_dir: candidate_pairs(*sides(spark, sf_dir), rules)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pairs(*sides(spark, sf_dir), RULES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return comparison_features(candidate_pairs(a, b, RULES), a, b, COMPARISONS)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    pairs = candidate_pairs(a, b, RULES).select("left_record_key", "right_record_key")
    side = lambda df, k, p: df.select(F.col("record_key").alias(k), *[F.col(f"v_{v}").alias(f"{p}_{v}") for v in ("label", "date", "group")])
    return pairs.join(side(a, "left_record_key", "l"), "left_record_key").join(side(b, "right_record_key", "r"), "right_record_key")


def _compare(variable, function):
    def query(spark, sf_dir):
        value = function(F.col(f"l_{variable}"), F.col(f"r_{variable}"))
        return _paired(spark, sf_dir).select("left_record_key", "right_record_key", F.round(value, 6).alias("value"))

    return query


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    value = S.round_double(S.numeric_difference(F.col("c_acctbal"), F.col("s_acctbal"), 100.0), 6)
    return block_join(c, s, ["nation"]).select(F.col("l").alias("c_custkey"), F.col("r").alias("s_suppkey"), value.alias("value"))


def norm_text(spark, sf_dir):
    b = read_table(spark, sf_dir, "source_b")
    return b.select("record_key", "load_id", N.strip(F.col("label_value")).alias("stripped"), N.collapse_whitespace(F.col("label_value")).alias("collapsed"), label_norm(F.col("label_value")).alias("lowered"))


def norm_casefold(spark, sf_dir):
    x = F.col("label_value")
    return read_table(spark, sf_dir, "source_b").select("record_key", N.casefold(N.unicode_normalise(N.collapse_whitespace(x), "NFKC")).alias("folded"), N.unicode_normalise(x, "NFC").alias("nfc"))


def norm_parse_date(spark, sf_dir):
    return read_table(spark, sf_dir, "source_b").select("record_key", "load_id", F.date_format(N.parse_date(F.col("date_value"), DATES), "yyyy-MM-dd").alias("day"))


def norm_numeric(spark, sf_dir):
    return read_table(spark, sf_dir, "source_b").select("record_key", "load_id", N.to_integer(F.col("date_value")).cast("string").alias("whole"), N.to_float(F.col("date_value")).alias("real"))


def norm_boolean(spark, sf_dir):
    return read_table(spark, sf_dir, "verified_labels").select("pair_digest", N.to_boolean(F.col("label")).alias("flag"))


def surrogate_key(spark, sf_dir):
    return read_table(spark, sf_dir, "source_a").select("record_key", N.surrogate_key("source_a", F.col("record_key")).alias("surrogate")).distinct()


def pair_digests(spark, sf_dir):
    v = read_table(spark, sf_dir, "verified_labels")
    return v.select("left_record_key", "right_record_key", N.pair_digest(F.col("left_record_key"), F.col("right_record_key")).alias("digest")).distinct()


def missing_flags(spark, sf_dir):
    p = prepared(spark, sf_dir, "source_b")
    return p.select("record_key", *[F.col(f"v_{v}").isNull().alias(f"m_{v}") for v in ("label", "date", "group")])


def zero_candidates(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.select("record_key").join(candidate_pairs(a, b, RULES).withColumnRenamed("left_record_key", "record_key"), "record_key", "left_anti")


def customers_like_suppliers(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_key"), F.col("c_nationkey").alias("v_nation"))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("record_key"), F.col("s_nationkey").alias("v_nation"))
    return candidate_pairs(c, s, {"nation": Exact("nation")}, unique=unique_keys(c) and unique_keys(s))


def parts_dedupe(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_key"), F.col("p_brand").alias("v_brand"), F.col("p_type").alias("v_type"), F.col("p_size").alias("v_size"), F.col("p_name").alias("v_name"))
    return candidate_pairs(p, None, {"made": AllOf((Exact("brand"), Exact("type"), Exact("size"))), "named": AllOf((Exact("name"), Exact("brand"), Exact("size")))})


def orders_near(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_key"), F.col("o_custkey").alias("v_customer"), F.to_date("o_orderdate").alias("v_day"))
    return candidate_pairs(o, None, {"month": AllOf((Exact("customer"), DateWindow("day", 30)))})


def features_query(spark, sf_dir):
    f = features(spark, sf_dir)
    # nullable flags leave as text, so that every engine shows their nulls alike
    return f.select(*[F.round(c, 6).alias(c) if c.endswith("_value") else F.col(c).cast("string").alias(c) if c.endswith("_exact") else F.col(c) for c in f.columns])


def cmp_levels(spark, sf_dir):
    return features(spark, sf_dir).select("left_record_key", "right_record_key", *[f"{c.id}_level" for c in COMPARISONS])


def cmp_missing_flags(spark, sf_dir):
    return features(spark, sf_dir).select("left_record_key", "right_record_key", F.col("date_exact").cast("string").alias("date_exact"), *[f"date_missing_{s}" for s in ("left", "right", "both", "any")])


def random_pair_sample(spark, sf_dir):
    return random_pairs(*sides(spark, sf_dir), n=500, seed=7, scratch=Scratch(spark, "sample"))


QUERIES = {
    "norm_text": norm_text, "norm_casefold": norm_casefold, "norm_parse_date": norm_parse_date, "norm_numeric": norm_numeric, "norm_boolean": norm_boolean,
    "surrogate_key": surrogate_key, "pair_digests": pair_digests, "missing_flags": missing_flags,
    **{name: _block(rules) for name, rules in BLOCKS.items()},
    "candidates_multi_rule": candidates, "candidates_dedupe": parts_dedupe, "candidates_nation": customers_like_suppliers, "candidates_orders_window": orders_near,
    "candidate_diagnostics": lambda s, d: candidate_diagnostics(candidates(s, d)), "random_pair_sample": random_pair_sample, "zero_candidate_sources": zero_candidates,
    "cmp_exact": _compare("group", S.exact_similarity), "cmp_jaro_winkler": _compare("label", S.jaro_winkler), "cmp_levenshtein": _compare("label", S.levenshtein_similarity),
    "cmp_levenshtein_max": _compare("label", lambda a, b: S.levenshtein_similarity(a, b, 6)), "cmp_damerau": _compare("label", S.damerau_similarity),
    "cmp_qgram": _compare("label", lambda a, b: S.qgram_similarity(a, b, 2)), "cmp_date_day": _compare("date", lambda a, b: S.date_difference(a, b, "day")),
    "cmp_date_month": _compare("date", lambda a, b: S.date_difference(a, b, "month")), "cmp_date_year": _compare("date", lambda a, b: S.date_difference(a, b, "year")),
    "cmp_numeric": _balances, "cmp_features": features_query, "cmp_levels": cmp_levels, "cmp_missing_flags": cmp_missing_flags,
    "anchor_evidence": lambda s, d: anchor_evidence(*sides(s, d), ANCHORS), "anchor_conflicts": lambda s, d: anchor_conflicts(anchor_evidence(*sides(s, d), ANCHORS)),
}

_SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
_collapse = lambda x: _strip(f"regexp_replace({x}, '{_SP}+', ' ', 'g')")
_lower = lambda x: f"nullif(lower({_collapse(x)}), '')"
_date = lambda x: (f"(case when regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_strptime({x}, '%Y-%m-%d') "  # noqa: E731
                   f"when regexp_matches({x}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then try_strptime({x}, '%d/%m/%Y') "
                   f"when regexp_matches({x}, '^[0-9]{{8}}$') then try_strptime({x}, '%Y%m%d') end)::date")


def _side(name: str) -> str:
    return f"""(select record_key, {_lower('label_value')} as v_label, {_date('date_value')} as v_date,
      nullif(upper(regexp_replace(group_value, '[^A-Za-z0-9]', '', 'g')), '') as v_group from (select *, row_number() over (partition by record_key
      order by load_id desc, updated_at desc nulls last, coalesce(label_value, ''), coalesce(date_value, ''), coalesce(group_value, '')) as rn from {name}) where rn = 1)"""


PREPARED = f"with pa as materialized {_side('source_a')}, pb as materialized {_side('source_b')}"


def _pairs(rules: dict[str, str]) -> str:
    every = " union all ".join(f"select a.record_key as l, b.record_key as r, '{n}' as rule from pa a join pb b on {c}" for n, c in rules.items())
    return f"""(select l as left_record_key, r as right_record_key, string_agg(rule, ',' order by rule) as retrieval_rule_ids, count(*)::integer as retrieval_rule_count
      from (select distinct l, r, rule from ({every})) group by l, r)"""


_eq = lambda v: f"a.v_{v} = b.v_{v}"
_pre = lambda v, n: f"substr(a.v_{v}, 1, {n}) = substr(b.v_{v}, 1, {n})"
_win = lambda v, n: f"abs(date_diff('day', a.v_{v}, b.v_{v})) <= {n}"
_RULES = {"date_initial": f"{_eq('date')} and {_pre('label', 1)}", "group_prefix": f"{_eq('group')} and {_pre('label', 3)}"}
CANDIDATES = PREPARED + ", c as materialized " + _pairs(_RULES)
_PAIRED = CANDIDATES + """, p as (select left_record_key, right_record_key, a.v_label as l_label, b.v_label as r_label, a.v_date as l_date, b.v_date as r_date,
  a.v_group as l_group, b.v_group as r_group from c join pa a on a.record_key = left_record_key join pb b on b.record_key = right_record_key)"""
_value = lambda e: _PAIRED + f" select left_record_key, right_record_key, round({e}, 6) as value from p"
_both = "l_label is not null and r_label is not null"
_sim = lambda d, m=None: (f"case when {_both} then " + (f"case when {d} > {m} then 0.0 " if m else "case when false then 0.0 ") +  # noqa: E731
                          f"when greatest(length(l_label), length(r_label)) = 0 then 1.0 else greatest(0.0, 1.0 - {d}::double / nullif(greatest(length(l_label), length(r_label)), 0)) end end")
_grams = lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substr({x}, i, 2)))"
_dice = f"case when {_both} then 2.0 * len(list_intersect({_grams('l_label')}, {_grams('r_label')})) / (len({_grams('l_label')}) + len({_grams('r_label')})) end"
_lev, _dam = "levenshtein(l_label, r_label)", "damerau_levenshtein(l_label, r_label)"
FEATURES = _PAIRED + f""", v as (select *, {_sim(_lev)} as label_value, {_dice} as gram_value, abs(date_diff('day', l_date, r_date))::double as date_value,
  case when l_group is not null and r_group is not null then case when l_group = r_group then 1.0 else 0.0 end end as group_value from p),
  f as materialized (select left_record_key, right_record_key, """ + ", ".join(
    f"{c}_value, case when l_{s} is null or r_{s} is null then 0 when l_{s} = r_{s} then 1 {w} else {e} end::integer as {c}_level, l_{s} = r_{s} as {c}_exact, l_{s} is null as {c}_missing_left, "
    f"r_{s} is null as {c}_missing_right, (l_{s} is null and r_{s} is null) as {c}_missing_both, (l_{s} is null or r_{s} is null) as {c}_missing_any"
    for c, s, w, e in (("label", "label", "when label_value >= 0.9 then 2 when label_value >= 0.75 then 3", 4), ("gram", "label", "when gram_value >= 0.6 then 2", 3),
                       ("date", "date", "when date_value <= 2.0 then 2 when date_value <= 31.0 then 3", 4), ("group", "group", "", 2))) + " from v)"
_ANCHOR = {"label_date": (f"{_eq('label')} and {_eq('date')}", True, True), "label_group": (f"{_eq('label')} and {_eq('group')}", True, False), "near_date": (f"{_pre('label', 5)} and {_win('date', 1)}", False, False)}
_EVIDENCE = PREPARED + ", e as (" + " union all ".join(
    f"select a.record_key as left_record_key, b.record_key as right_record_key, '{n}' as anchor_id, {str(l).lower()} as nl, {str(r).lower()} as nr from pa a join pb b on {c}" for n, (c, l, r) in _ANCHOR.items()) + """),
  w as (select *, count(*) over (partition by anchor_id, left_record_key) as left_match_count, count(*) over (partition by anchor_id, right_record_key) as right_match_count from e),
  ev as (select left_record_key, right_record_key, anchor_id, left_match_count, right_match_count, left_match_count = 1 as left_unique, right_match_count = 1 as right_unique,
  (not nl or left_match_count = 1) and (not nr or right_match_count = 1) as uniqueness_pass, 'evidence_only' as evidence_role, false as overrides_decision from w)"""

ORACLE = {
    "norm_text": f"select record_key, load_id, {_strip('label_value')} as stripped, {_collapse('label_value')} as collapsed, {_lower('label_value')} as lowered from source_b",
    "norm_parse_date": f"select record_key, load_id, strftime({_date('date_value')}, '%Y-%m-%d') as day from source_b",
    "norm_numeric": """select record_key, load_id, case when n = floor(n) then try_cast(n as bigint) end::varchar as whole, case when isfinite(f) then f end as real
      from (select *, try_cast(date_value as decimal(38,10)) as n, try_cast(date_value as double) as f from source_b)""",
    "norm_boolean": "select pair_digest, label = 1 as flag from verified_labels",
    "surrogate_key": "select distinct record_key, sha256('source_a' || chr(31) || record_key) as surrogate from source_a",
    "pair_digests": "select distinct left_record_key, right_record_key, sha256(left_record_key || chr(0) || right_record_key) as digest from verified_labels",
    "missing_flags": PREPARED + " select record_key, v_label is null as m_label, v_date is null as m_date, v_group is null as m_group from pb",
    "block_exact": PREPARED + " select * from " + _pairs({"date": _eq("date")}),
    "block_prefix": PREPARED + " select * from " + _pairs({"label": _pre("label", 6)}),
    "block_date_window": PREPARED + " select * from " + _pairs({"window": _win("date", 2)}),
    "block_all": PREPARED + " select * from " + _pairs({"all": f"{_eq('group')} and {_pre('label', 2)} and {_win('date', 30)}"}),
    "block_any": PREPARED + " select * from " + _pairs({"any": f"({_pre('label', 8)}) or ({_eq('date')} and {_eq('group')})"}),
    "candidates_multi_rule": CANDIDATES + " select * from c",
    "candidates_dedupe": """select l as left_record_key, r as right_record_key, string_agg(rule, ',' order by rule) as retrieval_rule_ids, count(*)::integer as retrieval_rule_count from (
      select a.p_partkey::varchar as l, b.p_partkey::varchar as r, 'made' as rule from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size
      union all select a.p_partkey::varchar, b.p_partkey::varchar, 'named' from part a join part b on a.p_name = b.p_name and a.p_brand = b.p_brand and a.p_size = b.p_size) where l < r group by l, r""",
    "candidates_nation": """select c_custkey::varchar as left_record_key, s_suppkey::varchar as right_record_key, 'nation' as retrieval_rule_ids, 1::integer as retrieval_rule_count
      from customer join supplier on c_nationkey = s_nationkey""",
    "candidates_orders_window": """select a.o_orderkey::varchar as left_record_key, b.o_orderkey::varchar as right_record_key, 'month' as retrieval_rule_ids, 1::integer as retrieval_rule_count
      from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey::varchar < b.o_orderkey::varchar and abs(date_diff('day', a.o_orderdate::date, b.o_orderdate::date)) <= 30""",
    "candidate_diagnostics": CANDIDATES + """ select count(*) as candidate_count, coalesce(sum((retrieval_rule_count > 1)::bigint), 0)::bigint as multi_rule_count,
      coalesce(max(retrieval_rule_count), 0)::integer as maximum_rule_count from c""",
    "random_pair_sample": PREPARED + """, x as (select record_key, row_number() over (order by record_key) - 1 as n from pa), y as (select record_key, row_number() over (order by record_key) - 1 as n from pb),
      d as (select id, ('0x' || substr(md5(id || ':l:7'), 1, 15))::bigint % (select count(*) from x) as i, ('0x' || substr(md5(id || ':r:7'), 1, 15))::bigint % (select count(*) from y) as j from range(1100) t(id)),
      u as (select i, j, min(id) as id from d group by 1, 2 order by 3 limit 500)
      select x.record_key as left_record_key, y.record_key as right_record_key from u join x on x.n = i join y on y.n = j""",
    "zero_candidate_sources": CANDIDATES + " select record_key from pa where record_key not in (select left_record_key from c)",
    "cmp_exact": _value("case when l_group is not null and r_group is not null then case when l_group = r_group then 1.0 else 0.0 end end::double"),
    "cmp_jaro_winkler": _value("jaro_winkler_similarity(l_label, r_label)"), "cmp_levenshtein": _value(_sim(_lev)), "cmp_levenshtein_max": _value(_sim(_lev, 6)),
    "cmp_damerau": _value(_sim(_dam)), "cmp_qgram": _value(_dice), "cmp_date_day": _value("abs(date_diff('day', l_date, r_date))::double"),
    "cmp_date_month": _value("abs(date_diff('month', l_date, r_date))::double"), "cmp_date_year": _value("abs(date_diff('year', l_date, r_date))::double"),
    "cmp_numeric": "select c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal) / 100.0, 6) as value from customer join supplier on c_nationkey = s_nationkey",
    "cmp_features": FEATURES + " select * replace (" + ", ".join(f"round({c}_value, 6) as {c}_value" for c in ("label", "gram", "date", "group")) + ", " + ", ".join(f"{c}_exact::varchar as {c}_exact" for c in ("label", "gram", "date", "group")) + ") from f",
    "cmp_levels": FEATURES + " select left_record_key, right_record_key, label_level, gram_level, date_level, group_level from f",
    "cmp_missing_flags": FEATURES + " select left_record_key, right_record_key, date_exact::varchar as date_exact, date_missing_left, date_missing_right, date_missing_both, date_missing_any from f",
    "anchor_evidence": _EVIDENCE + " select * from ev",
    "anchor_conflicts": _EVIDENCE + """ select left_record_key, string_agg(distinct anchor_id, ',' order by anchor_id) as anchor_ids from ev group by left_record_key
      having count(distinct right_record_key) > 1 or not bool_and(uniqueness_pass)""",
}
