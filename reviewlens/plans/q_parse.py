"""Parser and prompt queries (FN-0, FN-14, FN-17..19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .oracle import _WS, py_strip, with_ctes
from .registry import composed, query
from ..constants import CLASSES
from ..functions import parse as P
from ..functions.prompts import COMMENT_PH, STORE_PH, TEMPLATES, render_prompt


def parse_sql(expr: str, cot: bool, rule_names: bool = False) -> str:
    """The parser rules as one DuckDB CASE (written against the rule list)."""
    t = py_strip(expr)
    tl = f"lower({t})"
    grp = f"lower({py_strip(f'regexp_extract({t}, {chr(39)}(?i)Classification:{_WS}*([a-zA-Z{_WS[1:-1]}]+){chr(39)}, 1)')})"
    last = f"lower(string_split({t}, chr(10))[-1])"
    whens = [("classification_field", f"{grp} IN ({', '.join(repr(c) for c in CLASSES)})", grp)]
    for c in CLASSES:
        if cot:
            whens.append(("classification_anywhere", f"contains({tl}, 'classification: {c}')", f"'{c}'"))
    for c in CLASSES:
        whens.append(("ends_with_class", f"ends_with({tl}, '{c}')", f"'{c}'"))
    for c in CLASSES:
        whens.append(("last_line", f"contains({last}, '{c}')", f"'{c}'"))
    if not cot:
        for c in CLASSES:
            whens.append(("anywhere", f"contains({tl}, '{c}')", f"'{c}'"))
    # keep rule order: classification_anywhere rules belong right after rule 1
    body = " ".join(f"WHEN {cond} THEN {('%r' % name) if rule_names else val}" for name, cond, val in whens)
    other = "'unparsed'" if rule_names else t
    return f"CASE WHEN {expr} IS NULL THEN NULL {body} ELSE {other} END"


@query("parse_direct", with_ctes(f"""SELECT review_id, response, {parse_sql('response', False)} AS parsed
FROM fx_response""", "fx_response"))
def q_parse_direct(spark, sf_dir):
    """FN-17 (+FN-0): direct answer parser over eight answer shapes."""
    r = fx.fx_response(spark, sf_dir)
    return r.select("review_id", "response", P.parse_direct("response").alias("parsed"))


@query("parse_cot", with_ctes(f"""SELECT review_id, response, {parse_sql('response', True)} AS parsed
FROM fx_response""", "fx_response"))
def q_parse_cot(spark, sf_dir):
    """FN-18: chain-of-thought answer parser."""
    r = fx.fx_response(spark, sf_dir)
    return r.select("review_id", "response", P.parse_cot("response").alias("parsed"))


@query("parse_audit", with_ctes(f"""SELECT parser, rule, count(*) AS n,
  CAST(sum(CASE WHEN parsed IN ({', '.join(repr(c) for c in CLASSES)}) THEN 1 ELSE 0 END) AS BIGINT) AS n_class
FROM (SELECT 'direct' AS parser, {parse_sql('response', False, True)} AS rule, {parse_sql('response', False)} AS parsed FROM fx_response
      UNION ALL
      SELECT 'cot', {parse_sql('response', True, True)}, {parse_sql('response', True)} FROM fx_response)
GROUP BY parser, rule""", "fx_response"))
def q_parse_audit(spark, sf_dir):
    """FN-19: which rule decided each answer, per parser; unparsed count."""
    r = fx.fx_response(spark, sf_dir)
    d = r.select(F.lit("direct").alias("parser"), P.parse_rule("response", False).alias("rule"),
                 P.parse_direct("response").alias("parsed"))
    c = r.select(F.lit("cot").alias("parser"), P.parse_rule("response", True).alias("rule"),
                 P.parse_cot("response").alias("parsed"))
    return (d.unionByName(c).groupBy("parser", "rule")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("parsed").isin(*CLASSES).cast("long")).alias("n_class")))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TPLS = ["zero_shot", "few_shot", "few_shot_cot"]
_TPL_VALUES = ", ".join(f"({_sql_lit(n)}, {_sql_lit(TEMPLATES[n])})" for n in _TPLS)


@query("render_prompts", with_ctes(f"""SELECT c.review_id, t.template,
  replace(replace(t.body, {_sql_lit(STORE_PH)}, c.store_info), {_sql_lit(COMMENT_PH)}, c.text_info) AS prompt
FROM fx_composed c CROSS JOIN (VALUES {_TPL_VALUES}) AS t(template, body)""", "fx_composed"))
def q_render_prompts(spark, sf_dir):
    """FN-14: every composed review rendered with the three example-free
    templates (store placeholder replaced first, then the comment)."""
    c = composed(spark, sf_dir)
    tpl = F.explode(F.array(*[F.lit(n) for n in _TPLS])).alias("template")
    x = c.select("review_id", "store_info", "text_info", tpl)
    return x.select("review_id", "template", render_prompt("store_info", "text_info", F.col("template")).alias("prompt"))
