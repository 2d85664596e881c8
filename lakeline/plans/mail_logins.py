"""Count mail logins per user and keep the busy ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.functions.text import (
    after_last,
    collapse_spaces,
    contains_all,
    ends_in_ink,
    remove,
    strip,
    strip_left,
    strip_right,
    token,
)
from lakeline.operators.counting import by_count, count_by, having_over
from lakeline.operators.rows import split_rejects

# What a login line of the month holds (the rarest first, since a line is
# dropped at the first one it lacks), and where its user stands.
LOGIN_NEEDLES = ("imap-login: Login", "Jun ", "dovecot: ")
USER_TOKEN = 7
USER_START = "=<"
USER_END = ">,"
THRESHOLD = 2000


def login_events(
    lines: DataFrame,
    needles: Sequence[str] = LOGIN_NEEDLES,
    collapse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(username)`` per login line, and the login lines that name no user.

    Tokens are cut at single spaces, so a day padded with a second space shifts
    them by one; ``collapse`` treats a run of spaces as one.
    """
    line = F.col("value")
    logins = lines.where(contains_all(line, needles))
    # Lines are stripped: what a needle's own outer spaces match must not be at the line's end.
    spaced = [needle for needle in needles if needle != needle.strip()]
    if spaced:
        logins = logins.where(ends_in_ink(line) | contains_all(strip(line), spaced))
    # Leading whitespace would shift the tokens, trailing only ends up in the last one.
    cut = collapse_spaces(strip_left(line)) if collapse else strip_left(line)
    user = remove(after_last(token(cut, " ", USER_TOKEN), USER_START), USER_END)
    parsed = logins.withColumn("username", strip_right(user))
    good, rejected = split_rejects(parsed, F.col("username") != "")
    return good.select("username"), rejected.select("value")


def login_counts(
    lines: DataFrame,
    threshold: int = THRESHOLD,
    needles: Sequence[str] = LOGIN_NEEDLES,
    collapse: bool = False,
) -> DataFrame:
    """Users with more than ``threshold`` logins, busiest first."""
    events, _ = login_events(lines, needles, collapse)
    return by_count(having_over(count_by(events, "username"), threshold), "username")
