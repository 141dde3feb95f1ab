"""Model-answer parsers (FN-17, FN-18, FN-19) as column expressions.

Rules, tried in order on t = stripped answer (classes in CLASSES order):
 1. first 'Classification:<ws>*([a-zA-Z<ws>]+)' (any case), group stripped
    and lower-cased, accepted when it is a class
 2. CoT only: 'classification: <class>' anywhere in lower(t)
 3. lower(t) ends with a class
 4. the last line of t (after the last newline) contains a class
 5. direct only: a class anywhere in lower(t)
 6. otherwise t itself (later counted as a wrong class)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASSES, PY_WS
from .text import py_strip

_RULE1 = rf"(?iU)Classification:{PY_WS}*([a-zA-Z\s\x{{1c}}-\x{{1f}}]+)"


def _first_class(pred) -> Column:
    """First class (in class order) for which ``pred(class)`` holds."""
    return F.coalesce(*[F.when(pred(c), F.lit(c)) for c in CLASSES])


def _rules(answer, cot: bool) -> list[tuple[str, Column]]:
    t = py_strip(answer if isinstance(answer, Column) else F.col(answer))
    tl = F.lower(t)
    grp = F.lower(py_strip(F.regexp_extract(t, _RULE1, 1)))
    last_line = F.lower(F.substring_index(t, "\n", -1))
    rules = [("classification_field", F.when(grp.isin(*CLASSES), grp))]
    if cot:
        rules.append(("classification_anywhere",
                      _first_class(lambda c: tl.contains(f"classification: {c}"))))
    rules.append(("ends_with_class", _first_class(lambda c: tl.endswith(c))))
    rules.append(("last_line", _first_class(lambda c: last_line.contains(c))))
    if not cot:
        rules.append(("anywhere", _first_class(lambda c: tl.contains(c))))
    rules.append(("unparsed", t))
    return rules


def parse_direct(answer) -> Column:
    """FN-17: parser used for the zero_shot and few_shot templates."""
    return F.coalesce(*[e for _, e in _rules(answer, cot=False)])


def parse_cot(answer) -> Column:
    """FN-18: parser used for the few_shot_cot and cot_rag templates."""
    return F.coalesce(*[e for _, e in _rules(answer, cot=True)])


def parse_rule(answer, cot: bool) -> Column:
    """FN-19: name of the rule that decided the answer."""
    rules = _rules(answer, cot)
    out = None
    for name, e in rules[:-1]:
        out = (F.when(e.isNotNull(), F.lit(name)) if out is None
               else out.when(e.isNotNull(), F.lit(name)))
    a = answer if isinstance(answer, Column) else F.col(answer)
    return out.when(a.isNotNull(), F.lit("unparsed"))


def parse_for_template(answer, template) -> Column:
    """Pick the parser by template name (CoT for few_shot_cot and cot_rag)."""
    tpl = template if isinstance(template, Column) else F.lit(template)
    return F.when(tpl.isin("few_shot_cot", "cot_rag"), parse_cot(answer)).otherwise(parse_direct(answer))
