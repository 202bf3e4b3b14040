"""The intake grammar for single cells inside Python workers (the same rules as ``functions.values``)."""

from __future__ import annotations

import datetime
import re
from functools import lru_cache

from intakeforge.functions.values import CELL_CURRENCY, CELL_INT, CELL_NUMBER, CELL_PERCENT, FALSE_TOKENS, MONTHS, NULL_TOKENS, TRUE_TOKENS

_NULL = frozenset(NULL_TOKENS)
_BOOL = frozenset(TRUE_TOKENS + FALSE_TOKENS)
_RE = {k: re.compile(v, re.ASCII) for k, v in (("int", CELL_INT), ("float", CELL_NUMBER), ("currency", CELL_CURRENCY), ("percent", CELL_PERCENT))}
_DATE = re.compile(r"(\d{1,4})([-/.])(\d{1,2}|[A-Za-z]{3,})\2(\d{1,4})", re.ASCII)


def null_like(cell: str) -> bool:
    return cell.strip().lower() in _NULL


@lru_cache(maxsize=65536)
def fits_date(cell: str, token: str) -> bool:
    """Whether the day exists under the layout; an unknown layout accepts any known one."""
    m = _DATE.fullmatch(cell)
    if not m:
        return False
    a, sep, b, c = m.groups()
    order, named = token[:3], token.endswith("-mon")
    if order not in ("ymd", "mdy", "dmy"):
        return any(fits_date(cell, t) for t in ("ymd-", "ymd/", "mdy/", "dmy/", "dmy.", "dmy-mon"))
    if sep != token[3]:
        return False
    part = dict(zip(order, (a, b, c)))
    if len(part["y"]) != 4 or len(part["d"]) > 2:
        return False
    if named:
        if part["m"][:3].lower() not in MONTHS:
            return False
        month = MONTHS.index(part["m"][:3].lower()) + 1
    elif part["m"].isdigit() and len(part["m"]) <= 2:
        month = int(part["m"])
    else:
        return False
    try:
        datetime.date(int(part["y"]), month, int(part["d"]))
    except ValueError:
        return False
    return True


def fits(cell: str, kind: str, token: str = "") -> bool:
    """Whether a present cell fits; string, empty and unknown types fit anything."""
    s = cell.strip()
    if kind in _RE:
        return _RE[kind].fullmatch(s) is not None
    if kind == "bool":
        return s.lower() in _BOOL
    if kind == "date":
        return fits_date(s, token)
    return True
