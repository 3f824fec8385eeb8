"""Text as provenance compares it: normal form, windows, identity tokens.

Windows and tokens are built from JVM expressions.  Normalisation needs NFKC,
which Spark lacks: only texts outside ASCII go through an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of a window, and the step between indexed windows.
WINDOW, STEP = 32, 8
#: Length of the blocks that windows are cut from, a multiple of the step.
BLOCK = 256
#: White space as a regular expression class: ASCII and Unicode spaces.
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ASCII_WORD = "[A-Za-z0-9_]"

#: Identity tokens.
LINK = r"(?i)(?:https?://|mailto:)[^\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
EMAIL = r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_.-]*@[A-Za-z0-9_-]+\.[a-z]{2,}(?![A-Za-z0-9_])"
PATH = r"(?<![A-Za-z0-9_/])[/~][A-Za-z0-9_./-]{4,}"
IDENTIFIER = r"(?i)(?<![A-Za-z0-9_])[a-z0-9][a-z0-9_-]{7,}(?![A-Za-z0-9_])"
TAIL = r"[.,;:!?)\]]+$"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC of ``text``; ASCII text is its own."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def collapse(text: Column) -> Column:
    """``text`` in lower case with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES + "+", " "))


def normalize(text: Column) -> Column:
    """The form in which texts are compared."""
    return collapse(nfkc(text))


def blocks(normal: Column, step: int) -> Column:
    """(at, part): blocks of ``normal`` that hold each window of ``step`` once.

    Cutting windows from short blocks keeps the cost linear: ``substring``
    walks a string from its start.
    """
    last = F.length(normal) - WINDOW
    starts = F.sequence(F.lit(0), last, F.lit(BLOCK))
    span = BLOCK - step + WINDOW
    return F.when(last >= 0, F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(normal, at + 1, F.lit(span)).alias("part"))))


def windows(block: Column, step: int) -> Column:
    """(at, window) for each window of a block of :func:`blocks`."""
    offsets = F.sequence(F.lit(0), F.length(block["part"]) - WINDOW, F.lit(step))
    return F.transform(offsets, lambda i: F.struct((block["at"] + i).alias("at"), F.substring(block["part"], i + 1, F.lit(WINDOW)).alias("window")))


def trim_tail(token: Column) -> Column:
    """A token in lower case without the punctuation of its sentence."""
    return F.regexp_replace(F.lower(token), TAIL, "")


def other_spelling(path: Column, home: str) -> Column:
    """``~/x`` for ``home/x`` and the other way round; null where there is none."""
    home = home.lower().rstrip("/")
    if not home:
        return F.lit(None).cast("string")
    return F.when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).when(
        path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))
    )


def atoms(text: Column, home: str = "/home/agent") -> Column:
    """The identity tokens of ``text`` in order: links, addresses, paths in both
    spellings, identifiers with a digit."""
    whole = nfkc(text)
    found = lambda pattern: F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
    paths = F.flatten(F.transform(found(PATH), lambda p: F.filter(F.array(trim_tail(p), other_spelling(trim_tail(p), home)), lambda x: x.isNotNull())))
    ids = F.filter(F.transform(found(IDENTIFIER), F.lower), lambda t: t.rlike("[0-9]"))
    return F.array_distinct(F.concat(F.transform(found(LINK), trim_tail), F.transform(found(EMAIL), F.lower), paths, ids))


def sample(text: Column, most: int = 80) -> Column:
    """``text`` on one line, at most ``most`` characters, the last then an ellipsis."""
    flat = F.trim(F.regexp_replace(text, SPACES + "+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit(chr(0x2026)))).otherwise(flat)


def _base36(value: Column) -> Column:
    return F.lower(F.conv(value.cast("string"), 10, 36))


def window_key(window: Column) -> Column:
    """Two 32-bit hashes of a window (FNV-1a and djb2) in base 36."""
    codes = F.transform(F.filter(F.split(window, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    low = F.lit(0xFFFFFFFF).cast("long")
    fnv = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193).cast("long")).bitwiseAND(low))
    djb = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(low))
    return F.concat_ws(":", _base36(fnv), _base36(djb))


def parse_key(key: Column) -> Column:
    """The two numbers of a :func:`window_key`; null for anything else."""
    parts = F.split(key, ":")
    numbers = F.transform(parts, lambda p: F.conv(p, 36, 10).cast("decimal(20,0)"))
    good = key.rlike("^[0-9a-z]+:[0-9a-z]+$") & F.forall(numbers, lambda n: n <= 0xFFFFFFFF)
    return F.when(good, F.transform(numbers, lambda n: n.cast("long")))


def decode_once(text: Column) -> Column:
    """Percent escapes decoded strictly: null where they are malformed."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = text.rlike("%(?![0-9A-Fa-f]{2})") | (F.instr(decoded, chr(0xFFFD)) > 0) & (F.instr(text, chr(0xFFFD)) == 0)
    return F.when(~broken, decoded)


def decodings(text: Column, rounds: int = 3) -> Column:
    """Other spellings of ``text``: its percent decodings, and with plus signs
    as spaces."""
    found, now = [], text
    for _ in range(rounds):
        now = F.when(F.instr(now, "%") > 0, decode_once(now))
        found.append(now)
    spaced = F.when(F.instr(text, "+") > 0, F.replace(text, F.lit("+"), F.lit(" ")))
    found += [spaced, F.when(F.instr(spaced, "%") > 0, decode_once(spaced))]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull() & (x != text)))


#: A word of speech, and what neither counts nor breaks a run.
PROSE_WORD = r"^\p{L}{2,}[,.!?;:)]?$"
PROSE_FILLER = r"^(?:\p{N}[\p{N}.,]*|\p{L})$"


def prose_run(text: Column) -> Column:
    """The longest run of words between single spaces, fillers aside."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, token: Column) -> Column:
        run = F.when(token.rlike(PROSE_WORD), s["run"] + 1).when(token.rlike(PROSE_FILLER), s["run"]).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.split(text, " ", -1), zero, step)["best"]
