"""Scalar text/date helpers as built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip()/str.split() treat as whitespace, written as
# one regex class understood by both Java regex and RE2.
PY_WS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
PY_NON_WS = PY_WS[0] + "^" + PY_WS[1:]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()``: trim Python whitespace at both ends."""
    return F.regexp_replace(_c(x), f"^{PY_WS}+|{PY_WS}+$", "")


def md5_uuid(x) -> Column:
    """MD5 hex laid out 8-4-4-4-12; null stays null."""
    return F.regexp_replace(
        F.md5(_c(x).cast("string")),
        r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def embed_input(id_col, descr_col) -> Column:
    """``id + ': ' + description`` (null when either is null)."""
    return F.concat(_c(id_col).cast("string"), F.lit(": "), _c(descr_col))


def title_case(x, spaces: bool = True) -> Column:
    """Python ``str.title()``: upper after every non-letter, lower elsewhere.

    With ``spaces`` the ``_`` and ``-`` become spaces first (listing names).
    Not ``initcap``: ``chef's`` -> ``Chef'S``, ``5pm`` -> ``5Pm``.
    Known gap: characters whose title case differs from their upper case
    (``ß`` -> Python ``Ss``, here ``SS``).
    """
    s = _c(x)
    if spaces:
        s = F.replace(F.replace(s, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        "",
    )


def age_years(dob, as_of) -> Column:
    """Whole years between ``dob`` and ``as_of`` (calendar, leap-day safe)."""
    return (F.months_between(_c(as_of), _c(dob)) / 12).cast("int")


def epoch_day_format(days) -> Column:
    """Days since 1970-01-01 -> ``yyyy/MM/dd`` (UTC; no local-time shift)."""
    return F.date_format(F.date_from_unix_date(_c(days).cast("int")), "yyyy/MM/dd")


def message_id(ts, dtype) -> Column:
    """Epoch millis, truncated; ``dtype`` is the column's timestamp type
    (TIMESTAMP_NTZ is read as UTC wall clock, independent of the session)."""
    from .time import epoch_ms

    return epoch_ms(_c(ts), dtype)


def default_if_empty(x, default) -> Column:
    """Falsy default: null and '' both become ``default``; ' ' stays."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def flatten_ws(x) -> Column:
    """Drop CR; LF and TAB become a space; runs of spaces become one."""
    s = F.replace(_c(x), F.lit("\r"), F.lit(""))
    s = F.translate(s, "\n\t", "  ")
    return F.regexp_replace(s, " +", " ")


NAME_CHARS = r"[\p{L}\p{N}_-]"  # Python's Unicode \w plus '-'


def placeholders(x, prefix: str = r"\$ENV\.") -> Column:
    """Distinct placeholder names ``<prefix>NAME`` found in the text."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(prefix + f"({NAME_CHARS}*)"), 1))


def substitute_vars(x, variables: dict[str, str]) -> Column:
    """Replace every ``$ENV.NAME`` by its value, unknown names by ''.

    One pass over the original text: it is cut into placeholders and plain
    runs, each placeholder is looked up on its own (so ``$ENV.A`` never
    touches ``$ENV.AB``, and a substituted value is never re-read).
    """
    pieces = F.regexp_extract_all(_c(x), F.lit(rf"(\$ENV\.{NAME_CHARS}*|[^$]+|\$)"), 1)
    lookup = F.create_map(*[v for k, val in variables.items() for v in (F.lit(k), F.lit(val))]) if variables else None

    def sub(p):
        name = F.substr(p, F.lit(6))
        value = F.coalesce(lookup[name], F.lit("")) if lookup is not None else F.lit("")
        return F.when(p.startswith("$ENV."), value).otherwise(p)

    return F.array_join(F.transform(pieces, sub), "")


def split_statements(x, sep: str = ";") -> Column:
    """Split on ``sep``, strip, drop empties, re-append ``sep`` (array)."""
    import re

    parts = F.split(_c(x), re.escape(sep))
    trimmed = F.transform(parts, lambda p: py_strip(p))
    kept = F.filter(trimmed, lambda p: p != F.lit(""))
    return F.transform(kept, lambda p: F.concat(p, F.lit(sep)))


def first_match(x, pattern: str, group: int = 1) -> Column:
    """First regex match (group) or ''."""
    return F.regexp_extract(_c(x), pattern, group)


def clean_reply(x) -> Column:
    """Reply clean-up: strip; ``>\\n<`` -> ``><``; newline runs -> ``<br>``."""
    s = py_strip(x)
    s = F.replace(s, F.lit(">\n<"), F.lit("><"))
    return F.regexp_replace(s, "\n+", "<br>")


def reply_key(session, mid) -> Column:
    """``session:mid``; a null mid prints ``None`` like the original."""
    return F.concat_ws(":", _c(session).cast("string"), F.coalesce(_c(mid).cast("string"), F.lit("None")))


def salted_digest(x, salt: str) -> Column:
    """SHA-256 of salt + value (masking; not the original DES crypt)."""
    return F.sha2(F.concat(F.lit(salt), _c(x).cast("string")), 256)


def clock_text(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def session_key(x) -> Column:
    """Deterministic 32-hex session key (MD5 of a key)."""
    return F.md5(_c(x).cast("string"))


def random_session_key() -> Column:
    """Random 32-hex session id (non-deterministic)."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def py_str(x) -> Column:
    """``str(value)`` as Python prints it for the common scalar types."""
    c = _c(x)
    return F.coalesce(c.cast("string"), F.lit("None"))


def whitespace_tokens(x) -> Column:
    """Number of ``str.split()`` tokens."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(PY_NON_WS + "+"), 0))


# -- fixed values: menu request wording of the original front end -------------
MENU_QUERY = "Show me the {section} on the {menu} menu"
MENU_WAIT = "Getting you the {section} on the {menu} menu..."


def templated_query(section, menu: str) -> Column:
    """Query text for a menu section and the matching wait line."""
    return F.format_string(MENU_QUERY.format(section="%s", menu=menu), _c(section))


def templated_wait(section, menu: str) -> Column:
    return F.format_string(MENU_WAIT.format(section="%s", menu=menu), F.replace(_c(section), F.lit("_"), F.lit(" ")))
