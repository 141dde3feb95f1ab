"""Prompt templates and rendering (FN-14, FN-15).

Rendering is three chained ``replace`` expressions (store, then comment,
then examples, so a placeholder inside the store text is itself replaced,
as str.replace chains do). The wording of the templates is our own; the
placeholders and template names are fixed values.

Fixed values: placeholders [STORE_INFO_PLACEHOLDER],
[USER_COMMENT_PLACEHOLDER], [RETRIEVED_EXAMPLES_PLACEHOLDER]; template
names zero_shot, few_shot, few_shot_cot, cot_rag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_PH = "[STORE_INFO_PLACEHOLDER]"
COMMENT_PH = "[USER_COMMENT_PLACEHOLDER]"
EXAMPLES_PH = "[RETRIEVED_EXAMPLES_PLACEHOLDER]"

_CLASS_GUIDE = """Label the review with exactly one of these classes:
- valid: a genuine account of a visit or of the product or service
- advertisement: promotes something, links, codes, contact details
- irrelevant: not about this business at all
- rants without visit: complaints from someone who never went there"""

_BUSINESS = f"""Business:
{STORE_PH}

Review:
{COMMENT_PH}"""

_EXAMPLES = """Worked examples:
Business: Riverside bicycle workshop, repairs while you wait
Review: "They trued my wheel in twenty minutes and showed me the worn spoke."
Classification: valid

Business: Riverside bicycle workshop, repairs while you wait
Review: "Half price roof cleaning all month, call Dana and quote BIKE10."
Classification: advertisement

Business: Riverside bicycle workshop, repairs while you wait
Review: "The sunset over the harbour was orange tonight."
Classification: irrelevant

Business: Riverside bicycle workshop, repairs while you wait
Review: "My neighbour says they overcharge, so I would not set foot inside."
Classification: rants without visit"""

TEMPLATES = {
    "zero_shot": f"""You check reviews of local businesses.
{_CLASS_GUIDE}

{_BUSINESS}

Answer with one line: Classification: <class>""",
    "few_shot": f"""You check reviews of local businesses.
{_CLASS_GUIDE}

{_EXAMPLES}

Now the review to label.
{_BUSINESS}

Answer with one line: Classification: <class>""",
    "few_shot_cot": f"""You check reviews of local businesses.
{_CLASS_GUIDE}

{_EXAMPLES}

Now the review to label.
{_BUSINESS}

Think step by step. Write your reasoning first, then end with the line
Classification: <class>""",
    "cot_rag": f"""You check reviews of local businesses.
{_CLASS_GUIDE}

Similar labelled reviews from our records:
{EXAMPLES_PH}

Now the review to label.
{_BUSINESS}

Think step by step using the similar reviews. Write your reasoning first,
then end with the line
Classification: <class>""",
}

#: shown name, what the template asks for
TEMPLATE_INFO = {
    "zero_shot": ("Guide only", "Class guide and review; one answer line"),
    "few_shot": ("Guide and four cases", "Adds one worked case of each class; one answer line"),
    "few_shot_cot": ("Four cases, argued", "Worked cases; asks for an argument before the answer line"),
    "cot_rag": ("Retrieved cases, argued", "Cases come from the vector index; asks for an argument before the answer line"),
}


def template_names() -> list[str]:
    return list(TEMPLATES)


def template_column(template) -> Column:
    """Template text for a literal name or a per-row name column; an unknown
    name raises at run time (lazy ``raise_error``)."""
    if isinstance(template, str):
        if template not in TEMPLATES:
            raise ValueError(f"no template {template!r}; there are {', '.join(TEMPLATES)}")
        return F.lit(TEMPLATES[template])
    m = F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), F.lit(v))])
    txt = F.element_at(m, template)
    return F.when(txt.isNotNull(), txt).otherwise(
        F.raise_error(F.concat(F.lit("no template "), F.coalesce(template, F.lit("NULL")))))


def render_prompt(store, comment, template="few_shot", examples=None) -> Column:
    """FN-14: fill a template. ``cot_rag`` needs ``examples``."""
    store = F.col(store) if isinstance(store, str) else store
    comment = F.col(comment) if isinstance(comment, str) else comment
    if isinstance(template, str) and template == "cot_rag" and examples is None:
        raise ValueError("the cot_rag template needs examples")
    out = F.replace(template_column(template), F.lit(STORE_PH), store)
    out = F.replace(out, F.lit(COMMENT_PH), comment)
    if examples is not None:
        ex = F.col(examples) if isinstance(examples, str) else examples
        tpl = F.lit(template) if isinstance(template, str) else template
        out = F.when(tpl == "cot_rag", F.replace(out, F.lit(EXAMPLES_PH), ex)).otherwise(out)
    return out


def templates_df(spark):
    """FN-15: the template registry as a 4-row table."""
    rows = [(i, k, TEMPLATE_INFO[k][0], TEMPLATE_INFO[k][1], k in ("few_shot_cot", "cot_rag"))
            for i, k in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, template string, name string, "
                                       "description string, chain_of_thought boolean")
