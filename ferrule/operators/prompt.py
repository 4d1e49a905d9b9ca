"""Prompt / report assembly as line rows (the scalable form), folded last
in bounded chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import age_years, default_if_empty, py_str, title_case
from .scan import grouped_scan

# -- fixed values: wording and section lists of the original prompt -----------
PROMPT_INTRO = "You are an AI Assistant for a restaurant. Your name is: {waiter}."
PROMPT_PARTS = {
    1: "1. You MUST comply with these AI rules:",
    2: "2. Details about the restaurant you work for:",
    3: "3. Restaurant policies:",
    4: "4. Main menu:",
    5: "5. Kids menu:",
}
MAIN_MENU_SECTIONS = ["starters", "mains", "alcoholic_drinks", "non_alcoholic_drinks", "hot_drinks", "desserts"]
KIDS_MENU_SECTIONS = ["starters", "mains", "drinks", "desserts"]
NEW_CUSTOMER = "\nWe have a new customer. Their name is {name}, {dob} and is allergic to {allergies}"
NO_ALLERGIES = "nothing"

# -- fixed values: mark-up of the original data page ----------------------------
LISTING_CATEGORY = "<h4 class='text-warning mt-3'>%s</h4>"
LISTING_KEY = "<h5 class='text-info mt-1'>&emsp;%s</h5>"
LISTING_FIELD = "&emsp;&emsp;%s:&nbsp;<span class='text-muted'>%s</span><br>"

LINE_SCHEMA = "part_no int, section_no int, item_no bigint, text string"


def _py_title(name: str) -> str:
    return name.title()


def attribute_list(exclude: list[str], columns: list[str]) -> Column:
    """``Key Value, Key Value`` over ``columns`` minus ``exclude``, in column
    order; keys as ``str.title()``, null prints ``None``."""
    return F.concat_ws(
        ", ", *[F.concat(F.lit(_py_title(c) + " "), py_str(c)) for c in columns if c not in exclude]
    )


def sectioned_listings(
    menus: list[tuple[DataFrame, list[str], int]],
    section_col: str,
    name_col: str,
    descr_col: str,
    attr_cols: list[str],
    order: list[str],
) -> DataFrame:
    """``ord.section`` headers and ``ord.section.item`` lines of one or more
    listings ``(items, sections, ord)``, numbered in one split scan.

    Sections follow each given list: an empty section keeps its number and
    header, an item of a section not in the list is left out.  Items are
    numbered in ``order`` inside their section.
    """
    spark = menus[0][0].sparkSession
    sec = F.broadcast(
        spark.createDataFrame(
            [(o, i + 1, s) for _, sections, o in menus for i, s in enumerate(sections)],
            "part_no int, section_no int, section string",
        )
    )
    headers = sec.select(
        "part_no",
        "section_no",
        F.lit(0).cast("long").alias("item_no"),
        F.concat(F.col("part_no").cast("string"), F.lit("."), F.col("section_no").cast("string"), F.lit(" "),
                 title_case("section"), F.lit(":")).alias("text"),
    )
    items = None
    for df, _, o in menus:
        d = df.withColumn("part_no", F.lit(o))
        items = d if items is None else items.unionByName(d)
    known = sec.select(F.col("part_no").alias("_part"), "section_no", F.col("section").alias("_section"))
    joined = items.join(known, (F.col("part_no") == F.col("_part")) & (items[section_col] == F.col("_section"))).drop("_part", "_section")
    numbered = grouped_scan(joined, ["part_no", "section_no"], order, number="item_no")
    lines = numbered.select(
        "part_no",
        "section_no",
        "item_no",
        F.concat(
            F.col("part_no").cast("string"),
            F.lit("."),
            F.col("section_no").cast("string"),
            F.lit("."),
            F.col("item_no").cast("string"),
            F.lit(" "),
            title_case(name_col),
            F.lit(" ("),
            py_str(descr_col),
            F.lit("): "),
            attribute_list([], attr_cols),
        ).alias("text"),
    )
    return headers.unionByName(lines)


def sectioned_listing(items: DataFrame, sections: list[str], ord: int, **kw) -> DataFrame:
    """One listing; see :func:`sectioned_listings`."""
    return sectioned_listings([(items, sections, ord)], **kw)


def bullet_lines(states: list[tuple[int, DataFrame]]) -> DataFrame:
    """``- Key: value`` lines of state tables (key, value, ord) in state
    order, one numbering per part, in one split scan."""
    u = None
    for part_no, st in states:
        d = st.select(F.lit(part_no).alias("part_no"), F.col("key").cast("string").alias("key"),
                      py_str("value").alias("value"), F.col("ord").cast("long").alias("ord"))
        u = d if u is None else u.unionByName(d)
    n = grouped_scan(u, ["part_no"], ["ord"], number="item_no")
    return n.select(
        "part_no",
        F.lit(0).alias("section_no"),
        "item_no",
        F.concat(F.lit("- "), title_case("key"), F.lit(": "), F.col("value")).alias("text"),
    )


def initial_prompt_lines(
    spark: SparkSession,
    waiter: str,
    rules: DataFrame,
    details: DataFrame,
    policies: DataFrame,
    main_menu: DataFrame,
    kids_menu: DataFrame,
    menu_args: dict,
    main_sections: list[str] = MAIN_MENU_SECTIONS,
    kids_sections: list[str] = KIDS_MENU_SECTIONS,
) -> DataFrame:
    """All prompt lines: (part_no, section_no, item_no, text).

    ``rules``/``details``/``policies`` are state tables with columns
    (key, value, ord); menus are item tables described by ``menu_args``
    (see :func:`sectioned_listings`).
    """
    fixed = spark.createDataFrame(
        [(0, 0, 0, PROMPT_INTRO.format(waiter=waiter))] + [(p, 0, 0, t) for p, t in PROMPT_PARTS.items()],
        LINE_SCHEMA,
    )
    bullets = bullet_lines([(1, rules), (2, details), (3, policies)])
    menus = sectioned_listings([(main_menu, main_sections, 4), (kids_menu, kids_sections, 5)], **menu_args)
    return fixed.unionByName(bullets).unionByName(menus)


def fold_lines(lines: DataFrame, group: list[str], order: list[str], text: str = "text",
               chunk_col: str | None = None, chunk: int = 200) -> DataFrame:
    """Ordered ``\\n`` fold per group; with ``chunk_col`` each group is folded
    in pieces of ``chunk`` consecutive numbers of that column."""
    g = list(group)
    df = lines
    if chunk_col:
        df = df.withColumn("chunk", F.floor(F.col(chunk_col) / chunk).cast("long"))
        g.append("chunk")
    agg = df.groupBy(*g).agg(
        F.sort_array(F.collect_list(F.struct(*order, text))).alias("_l"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return agg.select(*g, "n_lines", F.array_join(F.transform("_l", lambda x: x[text]), "\n").alias("text"))


def customer_phrase(name, dob_text, allergies, as_of) -> Column:
    """New-customer sentence: age when the date parses, else the raw text."""
    dob = F.try_to_date(F.col(dob_text) if isinstance(dob_text, str) else dob_text, "yyyy/MM/dd")
    age = age_years(dob, as_of)
    dob_s = F.coalesce(
        F.concat(F.lit("is "), age.cast("string"), F.lit(" years old")),
        F.concat(F.lit("was born in "), F.col(dob_text) if isinstance(dob_text, str) else dob_text),
    )
    given = {"name": F.col(name) if isinstance(name, str) else name, "dob": dob_s, "allergies": default_if_empty(allergies, NO_ALLERGIES)}
    parts = [p for p in re.split(r"\{(\w+)\}", NEW_CUSTOMER)]
    return F.concat(*[given[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def public_view(df: DataFrame, columns: list[str], secret: list[str], missing: str = "N/A") -> DataFrame:
    """Public projection: secret columns left out, falsy values shown as N/A."""
    return df.select(*[default_if_empty(F.col(c).cast("string"), missing).alias(c) for c in columns if c not in secret])


def flatten_listing(df: DataFrame, category: str, key: str, fields: list[str]) -> DataFrame:
    """Nested document (category -> key -> field -> value) as listing rows
    (category, key, depth, field, line): a heading per category (depth 0) and
    per key (depth 1), and an indented line per field (depth 2)."""
    stack = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), py_str(f).alias("value")) for f in fields])
    )
    rows = df.select(F.col(category).cast("string").alias("category"), F.col(key).cast("string").alias("key"), stack.alias("_f"))
    none = F.lit(None).cast("string")
    leaves = rows.select(
        "category",
        "key",
        F.lit(2).alias("depth"),
        F.col("_f.field").alias("field"),
        F.format_string(LISTING_FIELD, F.col("_f.field"), F.col("_f.value")).alias("line"),
    )
    keys = df.select(F.col(category).cast("string").alias("category"), F.col(key).cast("string").alias("key")).distinct()
    under = keys.select("category", "key", F.lit(1).alias("depth"), none.alias("field"), F.format_string(LISTING_KEY, F.col("key")).alias("line"))
    top = keys.select("category").distinct().select(
        "category", none.alias("key"), F.lit(0).alias("depth"), none.alias("field"), F.format_string(LISTING_CATEGORY, F.col("category")).alias("line"))
    return top.unionByName(under).unionByName(leaves)
