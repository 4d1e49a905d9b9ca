"""Application log lines: format, parse, mark up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, first_match, py_strip

# -- fixed values: log line layout and level order of the original ------------
# line: "[app] yyyy-MM-dd HH:mm:ss,SSS.SSS [LEVEL]: message"
APP_PATTERN = r"^\[(.*?)\]"
LEVEL_PATTERN = r"\[([A-Z]+)\]:"
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
LEVEL_RANK = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def format_log(app, ts, level, message) -> Column:
    """Render a log line the way the original handler does."""
    stamp = F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss,SSS")
    ms = F.date_format(_c(ts), "SSS")
    return F.concat(
        F.lit("["), _c(app), F.lit("] "), stamp, F.lit("."), ms, F.lit(" ["), _c(level), F.lit("]: "), _c(message)
    )


def level_rank(level) -> Column:
    m = F.create_map(*[x for k, v in LEVEL_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(level)], F.lit(0))


def log_app(line) -> Column:
    return first_match(line, APP_PATTERN)


def log_markup(line) -> Column:
    """HTML line: bold app tag, bold level + <br>, newlines -> <br>, wrapped in a div."""
    app = log_app(line)
    v = F.replace(py_strip(line), F.concat(F.lit("["), app, F.lit("]")), F.concat(F.lit("<b>["), app, F.lit("]</b>")))
    level = first_match(v, LEVEL_PATTERN)
    v = F.replace(py_strip(v), F.concat(F.lit("["), level, F.lit("]: ")), F.concat(F.lit("<b>["), level, F.lit("]</b><br>")))
    v = F.replace(v, F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("<div class='log-"), app, F.lit("'>"), v, F.lit("</div>"))


def log_level(line) -> Column:
    """Level as found after the app tag is marked up (first hit, else '')."""
    return first_match(line, LEVEL_PATTERN)


def parse_log(df, col: str = "value"):
    """Add ``app``, ``level`` (first ``[LEVEL]:``, else '') and ``message``
    (text after the first ``[LEVEL]: ``, else '')."""
    line = F.col(col)
    return df.withColumns(
        {
            "app": log_app(line),
            "level": log_level(line),
            "message": F.regexp_extract(line, r"\[[A-Z]+\]: ?([\s\S]*)$", 1),
        }
    )
