"""Boolean and text expressions that fold where a part is known while the plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Truth = Column | bool
Text = Column | str


def both(*parts: Truth) -> Truth:
    out: Truth = True
    for part in parts:
        if part is False or out is False:
            return False
        if part is not True:
            out = part if out is True else out & part
    return out


def either(*parts: Truth) -> Truth:
    out: Truth = False
    for part in parts:
        if part is True or out is True:
            return True
        if part is not False:
            out = part if out is False else out | part
    return out


def negated(part: Truth) -> Truth:
    return not part if isinstance(part, bool) else ~part


def said(text: Text | Callable[[], Text]) -> Text:
    """The text, built now if it has not been."""
    return text if isinstance(text, (str, Column)) else text()


def column(part: Truth | Text) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def joined(*parts: Text) -> Text:
    if all(isinstance(p, str) for p in parts):
        return "".join(parts)
    return F.concat(*[column(p) for p in parts])


def cases(*pairs: tuple[Truth, Text], otherwise: Text) -> Text:
    """The text of the first pair that holds."""
    live = []
    for test, text in pairs:
        if test is False:
            continue
        live.append((test, text))
        if test is True:
            break
    if live and live[-1][0] is True:
        otherwise = live.pop()[1]
    out = otherwise
    for test, text in reversed(live):
        out = F.when(test, column(text)).otherwise(column(out))
    return out
