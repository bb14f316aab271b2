"""String normalisation expressions (JVM-side, no UDF).

``normalize`` equals Python's ``" ".join(s.casefold().split())``:

* case folding by Python's own table: code points that fold to one are
  translated, the some hundred that fold to several are looked up one by one,
  only in texts that hold any.  Texts in ASCII are lower-cased.
* whitespace: Python splits on Unicode whitespace plus U+001C..U+001F, so
  runs of that class collapse to one space and the ends are stripped.
"""

from __future__ import annotations

import sys
from functools import cache
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

PY_WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
PY_VISIBLE = r"(?U)[^\s\x1c-\x1f]"
PY_WHITESPACE_EDGES = r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Code points that fold to another one, those they fold to, and the map of those that fold to several."""
    pairs = [(chr(c), chr(c).casefold()) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    single = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single), {a: b for a, b in pairs if len(b) > 1}


def casefold(col: Column) -> Column:
    """Python's ``str.casefold``."""
    before, after, several = _folds()
    folded = F.translate(col, ascii_uppercase + before, ascii_lowercase + after)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    one_by_one = F.array_join(F.transform(F.split(folded, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    rare = F.when(folded.rlike("[" + "".join(several) + "]"), one_by_one).otherwise(folded)
    return F.when(col.rlike(r"[^\x00-\x7F]"), rare).otherwise(F.lower(col))


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, PY_WHITESPACE_RUN, " "))


def normalize(col: Column) -> Column:
    """Case-folded, whitespace-collapsed, stripped text (null stays null)."""
    return collapse_whitespace(casefold(col))


def py_strip(col: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace plus U+001C..U+001F)."""
    return F.regexp_replace(col, PY_WHITESPACE_EDGES, "")


def safe_filename(path: Column) -> Column:
    """Last path segment with NUL removed and whitespace stripped; empty -> "document"."""
    name = F.element_at(F.split(path, "/"), -1)
    cleaned = F.regexp_replace(F.regexp_replace(name, "\u0000", ""), PY_WHITESPACE_EDGES, "")
    return F.when((cleaned.isNull()) | (cleaned == ""), F.lit("document")).otherwise(cleaned)


def safe_upload_name(name: Column) -> Column:
    """Upload-name variant: backslashes become slashes, last segment, '.'/'..' -> "document"."""
    last = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    cleaned = F.regexp_replace(F.regexp_replace(last, "\u0000", ""), PY_WHITESPACE_EDGES, "")
    return F.when(
        cleaned.isNull() | cleaned.isin("", ".", ".."), F.lit("document")
    ).otherwise(cleaned)


def json_string(col: Column) -> Column:
    """JSON string literal with non-ASCII kept (Python ``json.dumps(..., ensure_ascii=False)``)."""
    # the literal ends with a quote (or is null), so only the array's bracket is trimmed, and the text is made once
    return F.substring(F.rtrim(F.to_json(F.array(col)), F.lit("]")), 2, 1 << 30)
