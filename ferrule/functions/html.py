"""HTML/markdown rewrites on the text of a column: one scan into tags and what is
not a tag, then a rewrite of the tags alone (no tree is built)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# -- fixed values: fence replacements of the original, in their order ---------
FENCE_REPLACEMENTS = [
    ("`` `", "```"),
    ("`` ` ", "```"),
    ("```html", ""),
    ("```json", ""),
    ("```", ""),
]

HTML_WS = r"[ \t\n\f\r]"


def strip_fences(x) -> Column:
    s = _c(x)
    for a, b in FENCE_REPLACEMENTS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# One scan of a text: comments, script and style elements with their bodies, tags (quoted attribute values may hold any
# sign), runs of text, and single signs that begin none of these.
_TAG = r"""<[a-zA-Z/](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_SCAN = r"(?i)<!--[\s\S]*?-->|<script\b[^>]*+>[\s\S]*?</script\s*+>|<style\b[^>]*+>[\s\S]*?</style\s*+>|" + _TAG + r"|[^<]++|<"
_ATTRIBUTE = r"""[^ \t\n\f\r"'>/=]++(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>]++))?+"""


def html_tokens(x) -> Column:
    """A text as its comments, script and style elements, tags and runs of text, in order; joined they are the text.

    An unclosed comment, script, style or tag is no such token: its ``<`` stands alone and what follows is scanned on."""
    return F.regexp_extract_all(_c(x), F.lit(_SCAN), F.lit(0))


def _rewrite_tags(x, change) -> Column:
    return F.array_join(F.transform(html_tokens(x), change), "")


def html_headings(x) -> Column:
    """h1..h5 -> h6 (opening and closing tags; h6 stays; comments, scripts, styles and attribute values are left alone)."""
    return _rewrite_tags(x, lambda t: F.regexp_replace(t, r"(?i)^<(/?)h[1-5](?=[ \t\n\f\r>/])", "<$1h6"))


def html_set_class(x, element: str, classes: str) -> Column:
    """Set ``class`` on every opening ``element`` tag, in front of its other attributes, replacing any existing one."""

    def change(t: Column) -> Column:
        rest = F.regexp_extract(t, rf"(?i)^<{element}(?=[ \t\n\f\r>/])([\s\S]*?)(/?>)$", 1)
        name = F.regexp_extract(t, rf"(?i)^<({element})", 1)
        end = F.regexp_extract(t, r"(/?>)$", 1)
        own = F.filter(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: ~a.rlike(r"(?i)^class(?:[ \t\n\f\r]*=|$)"))
        made = F.concat(F.lit("<"), name, F.lit(f' class="{classes}"'), F.array_join(F.transform(own, lambda a: F.concat(F.lit(" "), a)), ""), end)
        return F.when(t.rlike(rf"(?i)^<{element}[ \t\n\f\r>/]"), made).otherwise(t)

    return _rewrite_tags(x, change)
