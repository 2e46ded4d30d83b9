"""Masking: a raw log line becomes a template by replacing its variable parts.

The order of the rules is part of the meaning: an early, specific rule must take its digits
before a later, general one. Every rule is one built-in ``regexp_replace``.

The shapes are written for Java's backtracking matcher. The first element of each is a plain
character test, and a look-behind for the left word boundary comes only after enough of the
shape has matched. Repetitions that can never give characters back are possessive, so a line of
one unbroken run, an unclosed quote or thousands of path segments still takes linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from string import ascii_letters, digits, hexdigits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: placeholders -------------------------------------------------------------
TIMESTAMP = "<TIMESTAMP>"
UUID = "<UUID>"
MAC = "<MAC>"
IPV6 = "<IPV6>"
IPV4 = "<IPV4>"
EMAIL = "<EMAIL>"
URL = "<URL>"
PATH = "<PATH>"
SECRET = "<SECRET>"
HEX = "<HEX>"
PID = "<PID>"
NUM = "<NUM>"
PLACEHOLDERS = [TIMESTAMP, UUID, MAC, IPV6, IPV4, EMAIL, URL, PATH, SECRET, HEX, PID, NUM]

# Stand-ins without digits: the number rule would otherwise eat the 6 and the 4.
IPV6_MARK = "\u0000IPVSIXMARK\u0000"
IPV4_MARK = "\u0000IPVFOURMARK\u0000"

# --- fixed values: shapes, in the order they are applied ------------------------------------
# Digits, word characters, white space and boundaries are meant for all scripts. Classes spell
# out their characters because Java tests a listed class with one table look-up and a class of
# ranges with one call per range.
D = r"\p{Nd}"
W = r"(?U:\w)"
S = r"(?U:\s)"
SPACE = r"\p{IsWhite_Space}"
H = f"[{hexdigits}]"
ALNUM = ascii_letters + digits
B64 = f"[{ALNUM}+/]"
LOCAL = f"[{ALNUM}._%+-]"
SCHEME = rf"[{ALNUM}+.\-]"
OCTET = rf"(?:25[0-5]|2[0-4]{D}|[01]?{D}?{D})"
WORD_ENDS = f"(?!{W})"

TIMESTAMP_SHAPE = (
    rf"{D}(?:{D}{{3}}[-/]{D}{{2}}[-/]{D}{{2}}[T ]{D}{{2}}:{D}{{2}}:{D}{{2}}"
    rf"(?:\.{D}+)?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
    rf"|(?<!{W}{D}){D}/[A-Z][a-z]{{2}}/{D}{{4}}"
    rf":{D}{{2}}:{D}{{2}}:{D}{{2}}(?: [+-]{D}{{4}})?)"
)
US_DATETIME_SHAPE = (
    rf"{D}(?<![/{D}]{D}){D}?/{D}{{1,2}}/{D}{{4}},?{S}++{D}{{1,2}}:{D}{{2}}:{D}{{2}}"
    rf"(?:[.,]{D}+)?(?:{S}?[AaPp][Mm]{WORD_ENDS})?"
)
UUID_SHAPE = rf"{H}{{8}}-(?<!{W}{H}{{8}}-){H}{{4}}-{H}{{4}}-{H}{{4}}-{H}{{12}}{WORD_ENDS}"
MAC_SHAPE = rf"{H}{{2}}[:-](?<!{W}{H}{{2}}[:-])(?:{H}{{2}}[:-]){{4}}{H}{{2}}{WORD_ENDS}"
IPV6_SHAPE = (
    rf"(?=[{hexdigits}:])(?:(?={H}{{1,4}}+:)(?<!{W})(?:(?:{H}{{1,4}}:){{7}}{H}{{1,4}}{WORD_ENDS}"
    rf"|(?:{H}{{1,4}}:){{1,7}}:(?:{H}{{1,4}}(?::{H}{{1,4}}){{0,5}}{WORD_ENDS})?)"
    rf"|::(?:{H}{{1,4}}:){{0,6}}{H}{{1,4}}{WORD_ENDS})"
)
CLOCK_SHAPE = rf"{D}(?<!{W}{D}){D}?:{D}{{2}}:{D}{{2}}(?:[.,]{D}+)?{WORD_ENDS}"
IPV4_SHAPE = rf"(?={D}{{1,3}}\.)(?<!{W})(?:{OCTET}\.){{3}}{OCTET}{WORD_ENDS}"
# A match starts at the head of a run of local-part characters, or where the last one ended.
EMAIL_SHAPE = (
    rf"{LOCAL}(?:(?<!{LOCAL}.)|(?<=\G.)){LOCAL}*+@[{ALNUM}.-]+\.[{ascii_letters}]{{2,}}"
)
# Likewise for a scheme; characters it cannot start with are kept.
URL_SHAPE = (
    rf"(?=[{ALNUM}+.\-])(?:(?<!{SCHEME})|\G)([{digits}+.\-]*+)[{ascii_letters}]{SCHEME}*+"
    rf"://[^{SPACE}\"'<>]+"
)
# The opening quote and slash, one more slash before the closing quote, which may be escaped.
QUOTED_PATH_SHAPE = (
    r"([\"'])/(?:(?<=\"/)(?=[^\"\\\n/]*+/)[^\"\\\n]*+(\\?\")"
    r"|(?<='/)(?=[^'\n/]*+/)[^'\n]*+('))"
)
PATH_SHAPE = r"(?U)(?:/[\w.\-]++){2,}+"
LABELLED_SECRET_SHAPE = (
    rf"(?=[pstaPSTAſ])(?<!{W})"
    r"(?iu:(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|authorization))"
    rf"({S}*+[:=]{S}*+)\"?([^{SPACE},;\"']+)\"?"
)
# --- fixed values: what keys of known services begin with, and what follows -------------------
KEY_PREFIX_SHAPE = (
    rf"(?=[Ags])(?<!{W})(?:AKIA[0-9A-Z]{{16}}{WORD_ENDS}|gh[pousr]_[A-Za-z0-9]{{20,255}}{WORD_ENDS}"
    rf"|sk-ant-[A-Za-z0-9_-]{{20,}}(?U:\b)|sk-[A-Za-z0-9]{{32,}}{WORD_ENDS})"
)
BASE64_SHAPE = rf"(?={B64}{{20}})(?U:\b)(?:{B64}{{4}}){{5,}}+(?:{B64}{{2}}==|{B64}{{3}}=)?"
HEX_RUN_SHAPE = rf"{H}{{8}}(?<!{W}{H}{{8}}){H}*+{WORD_ENDS}"
LABELLED_PID_SHAPE = rf"([pP][iI][dD](?:[= ]|(?<=\[...):{S}*+)){D}+"
NUMBER_SHAPE = rf"{D}+"


# (rule, shape, replacement); $n is a kept group.
RULES: list[tuple[str, str, str]] = [
    ("timestamp", TIMESTAMP_SHAPE, TIMESTAMP),
    ("us_datetime", US_DATETIME_SHAPE, TIMESTAMP),
    ("uuid", UUID_SHAPE, UUID),
    ("mac", MAC_SHAPE, MAC),
    ("ipv6", IPV6_SHAPE, IPV6_MARK),
    ("clock", CLOCK_SHAPE, TIMESTAMP),
    ("ipv4", IPV4_SHAPE, IPV4_MARK),
    ("email", EMAIL_SHAPE, EMAIL),
    ("url", URL_SHAPE, "$1" + URL),
    ("quoted_path", QUOTED_PATH_SHAPE, "$1" + PATH + "$2$3"),
    ("path", PATH_SHAPE, PATH),
    ("labelled_secret", LABELLED_SECRET_SHAPE, "$1$2" + SECRET),
    ("key_prefix", KEY_PREFIX_SHAPE, SECRET),
    ("base64", BASE64_SHAPE, SECRET),
    ("hex_run", HEX_RUN_SHAPE, HEX),
    ("labelled_pid", LABELLED_PID_SHAPE, "$1" + PID),
    ("number", NUMBER_SHAPE, NUM),
]



# Plain texts one of which a line must hold for a rule to find anything; a search for them takes a
# fraction of the rule's time. Rules that are not named are always tried.
NEEDED: dict[str, list[str]] = {
    "timestamp": [":"],
    "us_datetime": [":"],
    "uuid": ["-"],
    "mac": [":", "-"],
    "ipv6": [":"],
    "clock": [":"],
    "ipv4": ["."],
    "email": ["@"],
    "url": ["://"],
    "quoted_path": ["\"/", "'/"],
    "path": ["/"],
    "labelled_secret": [":", "="],
    "key_prefix": ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"],
}

# The end of a time of day, which all times have.
CLOCK_PART = rf":{D}{{2}}:{D}{{2}}"
# A part of every label in lower case. None holds an i or s, whose upper-case partners of other scripts
# (dotless and dotted i, long s) lower-casing doesn't bring back.
LABEL_PARTS = ["word", "wd", "ecret", "token", "key", "author"]

# What a line must contain for any rule to find something in it: most prose has none of it.
EVIDENCE_MARKS = [":", "/", "=", "@", "sk-ant-"]
EVIDENCE_SHAPE = f"{B64}{{20}}|{H}{{8}}|{H}{{2}}-{H}{{2}}-"


def _has_evidence(line: Column) -> Column:
    found = F.rlike(line, F.lit(D))
    for text in EVIDENCE_MARKS:
        found = found | F.contains(line, F.lit(text))
    return found | F.rlike(line, F.lit(EVIDENCE_SHAPE))


def _restore_marks(masked: Column) -> Column:
    masked = F.replace(masked, F.lit(IPV6_MARK), F.lit(IPV6))
    return F.replace(masked, F.lit(IPV4_MARK), F.lit(IPV4))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which may name its argument several times while value is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _holds(text: Column, needed: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needed])


def _several(text: Column, mark: str, n: int) -> Column:
    """Whether the text holds a mark n times or more."""
    return F.octet_length(F.substring_index(text, mark, n)) < F.octet_length(text)


def _shows_time(text: Column) -> Column:
    return _several(text, ":", 2) & F.rlike(text, F.lit(CLOCK_PART))


# What else a text must show for a rule to find anything, beyond one plain text.
SHOWN: dict[str, Callable[[Column], Column]] = {
    "timestamp": lambda t: _holds(t, ["-", "/"]) & _shows_time(t),
    "us_datetime": lambda t: F.contains(t, F.lit("/")) & _shows_time(t),
    "uuid": lambda t: _several(t, "-", 4),
    "mac": lambda t: _several(t, ":", 5) | _several(t, "-", 5) | (F.contains(t, F.lit(":")) & F.contains(t, F.lit("-"))),
    "ipv6": lambda t: F.contains(t, F.lit("::")) | _several(t, ":", 7),
    "clock": _shows_time,
    "ipv4": lambda t: _several(t, ".", 3),
    "labelled_secret": lambda t: _holds(F.lower(t), LABEL_PARTS),
    "labelled_pid": lambda t: F.contains(F.lower(t), F.lit("pid")),
}


def _may_find(name: str, text: Column) -> Column:
    """False only where the rule finds nothing in the text."""
    tests = [_holds(text, NEEDED[name])] if name in NEEDED else []
    if name in SHOWN:
        tests.append(SHOWN[name](text))
    return reduce(and_, tests)


def _where_needed(name: str, shape: str, replacement: str) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        return F.when(_may_find(name, text), F.regexp_replace(text, shape, replacement)).otherwise(text)

    return apply


def _all_rules(line: Column) -> Column:
    """The rules one after the other; each is passed by where the text lacks what it needs."""
    masked = line
    for name, shape, replacement in RULES:
        if name in NEEDED or name in SHOWN:
            masked = _bound(masked, _where_needed(name, shape, replacement))
        else:
            masked = F.regexp_replace(masked, shape, replacement)
    return _restore_marks(masked)


def mask(line: Column) -> Column:
    """The template of a line.

    One nested expression in which every rule names its input once, so that it stays one projection
    however it is moved around. A condition on a single rule would name the input twice and double the
    chain below it; so what it is on is bound as a lambda's variable.
    """
    masked = F.when(_has_evidence(line), _all_rules(line)).otherwise(line)
    # never NULL, so that no join or group on templates adds a NULL filter that masks once more
    return F.coalesce(masked, F.lit(""))


def normalize_lines(df: DataFrame, column: str = "line", into: str = "template_text") -> DataFrame:
    return df.withColumn(into, mask(F.col(column)))


PLACEHOLDER_PATTERN = "<(?:" + "|".join(p.strip("<>") for p in PLACEHOLDERS) + ")>"


def placeholder_kinds(template: Column) -> Column:
    """Every placeholder in a template, one array element per occurrence."""
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER_PATTERN), F.lit(0))


# Shapes that must never be left in a template.
AUDITED_SHAPES: dict[str, str] = {
    "uuid": UUID_SHAPE,
    "mac": MAC_SHAPE,
    "ipv6": IPV6_SHAPE,
    "clock": CLOCK_SHAPE,
    "ipv4": IPV4_SHAPE,
    "email": EMAIL_SHAPE,
    "url": URL_SHAPE,
    "hex_run": HEX_RUN_SHAPE,
}


def leaked_shapes(template: Column) -> Column:
    """Names of the audited shapes a template still shows; looked for where it holds what they need."""
    found = []
    for name, shape in AUDITED_SHAPES.items():
        shows = F.rlike(template, F.lit(shape))
        if name in NEEDED or name in SHOWN:
            shows = _may_find(name, template) & shows
        found.append(F.when(shows, F.lit(name)))
    return F.array_compact(F.array(*found))
