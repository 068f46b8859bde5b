"""Column functions for log text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common presets (pattern, replacement), in the order in which they apply.
COMMON_PRESET = [
    (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|(Nov|Dec)(?:ember)?)\s(\s\d|\d{2})", "<DateText>"),
    (r"\d{2}(\d{2}[\.|\-|\s]){2}\d{2}", "<Date>"),
    (r"(\d{2}\:){2}\d{2}(\.\d{1,3})?", "<Time>"),
    (r"(\d+\.){3}\d+(\:\d+)?", "<IPv4>"),
]

# Masks of the template miner (pattern, name), in order.
MASKS = [
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "ID"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "IP"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "HEX"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM"),
    (r"(?<=executed cmd )(\".+?\")", "CMD"),
]

# The same masks as Spark runs them: every match begins and ends at a border (no letter or digit on the other side), so
# the cheap first character is looked at before it, and a run of digits is taken once, without trying its parts again.
# Repeated groups are possessive: Java takes a call for each round of others, and lines of any length must not fill the stack.
_AT, _END, _RUN = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])", "[0-9a-f]{6,}+(?![A-Za-z0-9])"
_FOURS = f"(?:[0-9A-F]{{4}})++{_END}"  # a run of pieces of four
_FOUR = f"(?:[0-9A-F]{{4}}(?=(?:[0-9A-F]{{4}})*+{_END}))"  # one piece of such a run
FAST_MASKS = [
    (rf"(?=[0-9a-f]{{2}}){_AT}[0-9a-f]{{2,}}+(?::[0-9a-f]{{2,}}+{_END}){{3,}}+", "ID"),
    (rf"(?=\d){_AT}\d{{1,3}}+(?:\.\d{{1,3}}+){{3}}{_END}", "IP"),
    # three or more pieces of six: one run of 18, two runs of which one has 12, or three runs
    (rf"(?=[0-9a-f]{{6}}){_AT}(?:(?=[0-9a-f]{{18}}){_RUN}|(?=[0-9a-f]{{12}}){_RUN} {_RUN}|{_RUN} (?=[0-9a-f]{{12}}){_RUN}|{_RUN} {_RUN} {_RUN})(?: {_RUN})*+(?: {_END})?", "SEQ"),
    # four or more pieces of four, all in runs that end at a border
    (rf"(?=[0-9A-F]{{4}}){_AT}(?=(?:{_FOUR} ?){{3}}{_FOUR}){_FOURS}(?: {_FOURS})*+(?: {_END})?", "SEQ"),
    (rf"(?=0x){_AT}0x[a-f0-9A-F]++{_END}", "HEX"),
    (rf"(?=[-+\d]){_AT}[-+]?\d++{_END}", "NUM"),
    (r"(?<=executed cmd )\".+?\"", "CMD"),
]

# What a line must hold for any of the masks to match it: a digit, letters of a hexadecimal run or pair, or the word before a command.
MASKABLE = r"[0-9]|[A-F]{4}|[a-f]{2}(?:[a-f]{4}|:[a-f]{2})|executed cmd "

# Traceback and statement masks, in order.
TRACEBACK = [
    (r"(?<=statement )\[.+\]", "<SQL-STATEMENT>"),
    (r"at .*", "<ERROR-Traceback>"),
    (r"Caused by: .*", "<ERROR-Traceback>"),
    (r"\.{3} \d+ more", "<ERROR-Traceback>"),
    (r"\s{2,}", " "),
]

# Words that mark an error line whatever the configuration says.
ERROR_KEYWORDS = ["error", "fatal", "fail", "exception", "critical"]


def replace_chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Each rule's replacement in turn; replacements hold no groups."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def masked(text: Column) -> Column:
    """A line's template: the whole line with numbers, addresses and the like replaced by their kind.

    One look tells lines that no mask can match, which is cheaper than copying them for every mask.
    """
    return F.when(text.rlike(MASKABLE), replace_chain(text, [(p, f"<:{n}:>") for p, n in FAST_MASKS])).otherwise(text)


def masked_sql(column: str) -> str:
    """``masked`` in DuckDB, whose patterns have no look-around: borders are matched and put back.

    Neighbours share a border, so each mask goes over the line twice. Numbers first become one mark, which then takes its sign.
    """
    start, end = "(^|[^A-Za-z0-9])", "($|[^A-Za-z0-9])"
    before, after = MASKS[0][0].split("(([0-9a-f]{2,}:)")[0], "((?=[^A-Za-z0-9])|$)"
    for p, n in MASKS:
        if n == "NUM":
            for _ in range(2):
                column = f"regexp_replace({column}, '{start}\\d+{end}', '\\1' || chr(1) || '\\2', 'g')"
            column = f"replace(regexp_replace({column}, '(^|[^A-Za-z0-9\\x01])[-+]\\x01', '\\1' || chr(1), 'g'), chr(1), '<:NUM:>')"
        elif p.startswith(before):
            inner = p[len(before) : -len(after)].replace("(", "(?:")
            for _ in range(2):
                column = f"regexp_replace({column}, '{start}(?:{inner}){end}', '\\1<:{n}:>\\2', 'g')"
        else:
            column = f"regexp_replace({column}, '(executed cmd )(?:\".+?\")', '\\1<:{n}:>', 'g')"
    return column


def words_only(text: Column) -> Column:
    """Everything but letters, digits, marks and blanks becomes a space, then digits go; any alphabet."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\p{Nd}", "")


def first_line(text: Column) -> Column:
    """First line of the text without white space around it."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")[0]


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """Sorted keywords that the text contains in either case, comma-joined; null without one."""
    ordered, low = sorted(set(keywords)), F.lower(text)
    hits = [F.contains(low, F.lower(F.lit(k))) for k in ordered]  # no lambda: generated code lowers the text once
    return F.when(reduce(lambda a, b: a | b, hits), F.concat_ws(",", *(F.when(h, F.lit(k)) for h, k in zip(hits, ordered, strict=True))))


def detection_type(keyword: Column, sparse: Column) -> Column:
    """1 for a rare line with a keyword, 2 for a rare one, 3 for a keyword alone, else 0."""
    return F.when(keyword & sparse, 1).when(sparse, 2).when(keyword, 3).otherwise(0)
