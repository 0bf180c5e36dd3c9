"""Column-level helpers: cleaning, validation and scalar functions.

Everything here returns a :class:`pyspark.sql.Column` built from built-in
functions, so it stays inside whole-stage code generation; there is no Python
UDF anywhere in the library.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearhouse.sources.schemas import IMAGE_EXTENSIONS, RATING_MAX, RATING_MIN, SEASONS

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's str.strip() removes every character for which str.isspace() holds;
# Spark's trim() removes only spaces.  The set is built from that rule (all
# such characters lie below U+3001) and handed to btrim, which is code-generated.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def trim9(c: ColumnOrName) -> Column:
    """Strip leading and trailing whitespace like Python ``str.strip()``."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def trimmed_integer(text: Column, dtype: str = "bigint") -> Column:
    """``to_integer(trim9(text))``; text that is an integer as it stands is not
    trimmed, as comparing its characters with all white space costs most."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast(dtype)).otherwise(to_integer(trim9(text), dtype))


def concat_distinct(c: ColumnOrName) -> Column:
    """``GROUP_CONCAT(DISTINCT c)`` with a fixed ascending order.

    NULLs are skipped and an empty group gives NULL; a lone '' stays '' (T13).
    Aggregate expression: use inside ``agg``.
    """
    values = F.collect_set(col(c))
    return F.when(F.size(values) == 0, F.lit(None).cast("string")).otherwise(
        F.array_join(F.array_sort(values), ",")
    )


def join_sorted(arr: ColumnOrName) -> Column:
    """Render a sorted distinct array the way ``concat_distinct`` does (NULL when empty)."""
    a = col(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, F.lit(None).cast("string")).otherwise(
        F.array_join(F.array_sort(a), ",")
    )


def to_integer(text: Column, dtype: str = "bigint") -> Column:
    """Integer text (optional sign, ASCII digits) -> number, anything else -> NULL.

    The pattern test runs first so that malformed text never reaches the cast:
    a failing cast raises and catches an exception per value, which is slow.
    """
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(dtype))


def split_values(c: ColumnOrName) -> Column:
    """Split comma text, trim each part, drop blanks; duplicates are kept."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), ",")
    return F.filter(F.transform(parts, trim9), lambda x: x != "")


def first_value(c: ColumnOrName) -> Column:
    """First non-blank comma-separated value, else ''."""
    return F.coalesce(F.get(split_values(c), 0), F.lit(""))


def as_list(c: ColumnOrName) -> Column:
    """comma text (or array) -> trimmed, non-blank, distinct values in first-seen order."""
    return F.array_distinct(split_values(c))


def item_id_list(c: ColumnOrName) -> Column:
    """comma text -> distinct bigint ids, unparsable parts skipped, first-seen order."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), ",")
    ids = F.transform(parts, lambda x: trimmed_integer(x))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def rating_value(c: ColumnOrName) -> Column:
    """None, '', '0' (exactly, before any trimming) -> NULL; an integer 1-5
    (surrounding whitespace allowed) -> that int; anything else -> NULL.

    Pair with :func:`rating_error` to reject the invalid ones.
    """
    raw = col(c).cast("string")
    as_int = trimmed_integer(raw, "int")
    return F.when(_rating_blank(raw), F.lit(None).cast("int")).when(as_int.between(RATING_MIN, RATING_MAX), as_int)


def _rating_blank(raw: Column) -> Column:
    return raw.isNull() | (raw == "") | (raw == "0")


def rating_error(c: ColumnOrName) -> Column:
    """True when a rating is given (not None, '', '0') but is not an integer 1-5
    (so ' 0' and '  ' are errors, as ``int()`` of them is 0 or fails)."""
    raw = col(c).cast("string")
    return ~_rating_blank(raw) & rating_value(c).isNull()


def _season_map() -> Column:
    return F.create_map(*[x for s in SEASONS for x in (F.lit(s.lower()), F.lit(s))])


def season_values(c: ColumnOrName) -> Column:
    """split, trim, canonical case, distinct; an unknown season maps to NULL."""
    m = _season_map()
    return F.array_distinct(F.transform(split_values(c), lambda x: m[F.lower(x)]))


def season_error(c: ColumnOrName) -> Column:
    """True when any listed season is not one of the four canonical ones."""
    return F.exists(season_values(c), lambda x: x.isNull())


def required_name(c: ColumnOrName) -> Column:
    """the trimmed name, or NULL when blank (reject on NULL)."""
    t = trim9(col(c))
    return F.when(t != "", t)


def date_part(c: ColumnOrName) -> Column:
    """the first ten characters of a datetime text."""
    return F.substring(col(c), 1, 10)


def now_text(as_of: str | None = None) -> Column:
    """F8: 'YYYY-MM-DD HH:MM:SS' for ``as_of`` (fixed) or the query start time."""
    if as_of is not None:
        return F.lit(as_of)
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def today_text(as_of: str | None = None) -> Column:
    return date_part(now_text(as_of))


def optional_id(c: ColumnOrName) -> Column:
    """NULL, '' and 0 -> NULL (no id given), otherwise the bigint value
    (NULL when unparsable; surrounding white space is allowed).  The pattern asks
    for a digit other than 0, so that the text is tested and read once."""
    raw, some = col(c).cast("string"), r"^[+-]?0*[1-9][0-9]*\z"
    trimmed = trim9(raw)
    return F.when(raw.rlike(some), raw.try_cast("bigint")).otherwise(F.when(trimmed.rlike(some), trimmed.try_cast("bigint")))


def optional_id_error(c: ColumnOrName) -> Column:
    """True when something other than an integer is given (white space alone is)."""
    raw = col(c).cast("string")
    return F.coalesce(raw != "", F.lit(False)) & trimmed_integer(raw).isNull()


def image_allowed(c: ColumnOrName) -> Column:
    """the file name has a '.' and an allowed extension (case-insensitive)."""
    name = col(c)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return name.contains(".") & ext.isin(*IMAGE_EXTENSIONS)


def like_contains(c: ColumnOrName, query: str) -> Column:
    """``LOWER(c) LIKE '%' || lower(query) || '%'``.

    User-typed '%' and '_' remain wildcards (as in the source application); the
    escape character is one that does not occur in the pattern, so a '\\' typed
    by the user is an ordinary character (T7).
    """
    pattern = f"%{query.lower()}%"
    esc = next(ch for ch in "\x01\x02\x03\x04\x05\x06\x07" if ch not in pattern)
    return F.like(F.lower(col(c)), F.lit(pattern), F.lit(esc))


def all_of(preds: Iterable[Column]) -> Column:
    """F16: AND of optional predicates (TRUE when there are none)."""
    return functools.reduce(operator.and_, list(preds), F.lit(True))
