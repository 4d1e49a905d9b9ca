"""Queries: sectioned listings and prompt assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prompt import fold_lines, initial_prompt_lines, sectioned_listing
from ..session import table
from .registry import query
from .sqlparts import title_sql

# -- fixed values: section lists used on the part table ----------------------
# (one section never occurs -> empty section; ECONOMY is left out)
PART_SECTIONS = ["SMALL", "MEDIUM", "LARGE", "JUMBO", "PROMO", "STANDARD"]
KIDS_SECTIONS = ["SMALL", "PROMO", "JUMBO"]
WAITER = "Alex"
MENU_ARGS = dict(section_col="p_type", name_col="p_name", descr_col="p_brand",
                 attr_cols=["p_size", "p_retailprice"], order=["p_partkey"])


def _values(sections, alias="t"):
    return "(VALUES " + ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(sections)) + f") {alias}(section_no, section)"


def _listing_sql(src: str, sections, ord_: int) -> str:
    return f"""
    SELECT {ord_} AS part_no, section_no, 0::BIGINT AS item_no, '{ord_}.' || section_no::VARCHAR || ' ' || {title_sql('section')} || ':' AS text
    FROM {_values(sections)}
    UNION ALL
    SELECT {ord_}, section_no, item_no,
           '{ord_}.' || section_no::VARCHAR || '.' || item_no::VARCHAR || ' ' || {title_sql('p_name')} || ' (' || coalesce(p_brand, 'None') || '): '
           || 'P_Size ' || coalesce(p_size::VARCHAR, 'None') || ', P_Retailprice ' || coalesce(p_retailprice::VARCHAR, 'None')
    FROM (SELECT p.*, s.section_no, row_number() OVER (PARTITION BY s.section_no ORDER BY p.p_partkey) AS item_no
          FROM {src} p JOIN {_values(sections, 's')} ON p.p_type = s.section)"""


_LISTING_SQL = _listing_sql("part", PART_SECTIONS, 4)


def _listing(spark, d):
    return sectioned_listing(table(spark, d, "part"), PART_SECTIONS, 4, **MENU_ARGS)


@query("sectioned_listing", _LISTING_SQL)
def sectioned_listing_q(spark, d):
    """``4.s`` section headers and ``4.s.i`` item lines; empty section kept."""
    return _listing(spark, d)


@query("section_text", f"""
    SELECT part_no, section_no, (item_no // 200)::BIGINT AS chunk, count(*) AS n_lines,
           string_agg(text, chr(10) ORDER BY item_no) AS text
    FROM ({_LISTING_SQL}) GROUP BY ALL""")
def section_text(spark, d):
    """Ordered fold of each section's lines (in 200-line chunks)."""
    return fold_lines(_listing(spark, d), ["part_no", "section_no"], ["item_no"], chunk_col="item_no", chunk=200)


def _bullets_sql(part_no, src, key, value, order):
    return f"""SELECT {part_no} AS part_no, 0 AS section_no, row_number() OVER (ORDER BY {order}) AS item_no,
           '- ' || {title_sql(key)} || ': ' || coalesce({value}::VARCHAR, 'None') AS text FROM {src}"""


_PROMPT_SQL = f"""
    SELECT 0 AS part_no, 0 AS section_no, 0::BIGINT AS item_no, 'You are an AI Assistant for a restaurant. Your name is: {WAITER}.' AS text
    UNION ALL SELECT 1, 0, 0, '1. You MUST comply with these AI rules:'
    UNION ALL SELECT 2, 0, 0, '2. Details about the restaurant you work for:'
    UNION ALL SELECT 3, 0, 0, '3. Restaurant policies:'
    UNION ALL SELECT 4, 0, 0, '4. Main menu:'
    UNION ALL SELECT 5, 0, 0, '5. Kids menu:'
    UNION ALL {_bullets_sql(1, 'region', 'r_name', 'r_regionkey', 'r_regionkey')}
    UNION ALL {_bullets_sql(2, 'nation', 'n_name', 'n_regionkey', 'n_nationkey')}
    UNION ALL {_bullets_sql(3, 'supplier', 's_name', 's_acctbal', 's_suppkey')}
    UNION ALL {_listing_sql('part', PART_SECTIONS, 4)}
    UNION ALL {_listing_sql('part', KIDS_SECTIONS, 5)}"""


def _prompt_lines(spark, d):
    st = lambda t, k, v, o: table(spark, d, t).select(F.col(k).alias("key"), F.col(v).alias("value"), F.col(o).alias("ord"))
    part = table(spark, d, "part")
    return initial_prompt_lines(
        spark, WAITER,
        rules=st("region", "r_name", "r_regionkey", "r_regionkey"),
        details=st("nation", "n_name", "n_regionkey", "n_nationkey"),
        policies=st("supplier", "s_name", "s_acctbal", "s_suppkey"),
        main_menu=part, kids_menu=part,
        menu_args=MENU_ARGS, main_sections=PART_SECTIONS, kids_sections=KIDS_SECTIONS,
    )


@query("initial_prompt_lines", _PROMPT_SQL)
def initial_prompt_lines_q(spark, d):
    """The five-part prompt as numbered line rows (rules = region, details =
    nation, policies = supplier, menus = part)."""
    return _prompt_lines(spark, d)


@query("initial_prompt", f"""
    SELECT part_no, section_no, (item_no // 200)::BIGINT AS chunk, count(*) AS n_lines,
           string_agg(text, chr(10) ORDER BY item_no) AS text
    FROM ({_PROMPT_SQL}) GROUP BY ALL""")
def initial_prompt(spark, d):
    """The prompt folded to text per part/section in bounded chunks."""
    return fold_lines(_prompt_lines(spark, d), ["part_no", "section_no"], ["item_no"], chunk_col="item_no", chunk=200)
