"""Cleaning: what a human reader cannot see goes, and every removal is a finding.

The rules that a regular expression can state run in the JVM
(:func:`strip_always`, :func:`strip_comments`, :func:`mixed_script_words`).
:func:`sanitize` adds what needs a parser or recursion, in one Arrow function
over whole batches.
"""

from __future__ import annotations

import base64
import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import sample as sample_column

#: Characters without use in text that is read as data, in the
#: order of their rules.  Java's regular expressions and Python's regex share them.
ALWAYS = (
    ("zero-width", r"[\x{200B}\x{2060}-\x{2064}\x{FEFF}]"),
    ("soft-hyphen", r"\x{00AD}"),
    ("invisible-joiner-mark", r"[\x{034F}\x{180E}]"),
    ("unicode-tags", r"[\x{E0000}-\x{E007F}]"),
    ("bidi-control", r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
    ("annotation-control", r"[\x{FFF9}-\x{FFFB}]"),
    ("deprecated-format", r"[\x{206A}-\x{206F}]"),
    ("ansi-escape", r"\x1B(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)?|[@-Z\\-_])"),
)

#: Characters without use in their context; Python's regex only.
_HANGUL = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{115E}\x{1161}-\x{11FF}\x{A960}-\x{A97C}\x{D7B0}-\x{D7FB}\x{3131}-\x{3163}\x{3165}-\x{318E}\x{FFA1}-\x{FFDC}]"
_LETTER = r"[\p{Latin}\p{Cyrillic}\p{Greek}]"
CONTEXTUAL = (
    ("joiner-between-letters", rf"(?<={_LETTER})[\x{{200C}}\x{{200D}}](?={_LETTER})"),
    ("variation-selector", r"(?<!\p{Extended_Pictographic})(?:\x{FE0E}|\x{FE0F}(?!\x{20E3})|(?<![#*0-9])\x{FE0F})"),
    ("variation-selector", r"(?<!\p{Han})[\x{FE00}-\x{FE0D}\x{E0100}-\x{E01EF}]"),
    ("blank-filler", rf"(?<!{_HANGUL})[\x{{115F}}\x{{1160}}\x{{3164}}\x{{FFA0}}](?!{_HANGUL})"),
    ("blank-filler", r"(?<![\x{2801}-\x{28FF}])\x{2800}(?![\x{2801}-\x{28FF}])"),
)


def _python(pattern: str) -> regex.Pattern:
    return regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


_RULES = tuple((name, _python(pattern)) for name, pattern in (*ALWAYS, *CONTEXTUAL))


def strip_always(text: Column) -> Column:
    """``text`` without the characters of the unconditional rules."""
    for _, pattern in ALWAYS:
        text = F.regexp_replace(text, pattern, "")
    return text


def invisible_counts(text: Column) -> Column:
    """(detail, occurrences) of each unconditional rule that fires, in order."""
    found, rest = [], text
    for name, pattern in ALWAYS:
        found.append(F.struct(F.lit(name).alias("detail"), F.regexp_count(rest, F.lit(pattern)).cast("long").alias("occurrences")))
        rest = F.regexp_replace(rest, pattern, "")
    return F.filter(F.array(*found), lambda f: f["occurrences"] > 0)


COMMENT = r"(?s)<!--(.*?)-->"
#: Tags whose whole content is for machines.
DROP_TAGS = ("script", "style", "meta", "noscript", "template")


def _commented(page: Column) -> tuple[Column, Column]:
    """A page up to its last comment end, and the rest, which holds no comment.

    Every comment that begins in the first part ends there, so a search in it
    takes time in proportion.
    """
    rest = F.substring_index(page, "-->", -1)
    return F.left(page, F.length(page) - F.length(rest)), rest


def strip_comments(page: Column) -> Column:
    head, rest = _commented(page)
    return F.concat(F.regexp_replace(head, COMMENT, ""), rest)


def comments(page: Column) -> Column:
    """Samples of the comments that say something."""
    bodies = F.regexp_extract_all(_commented(page)[0], F.lit(COMMENT), F.lit(1))
    return F.transform(F.filter(bodies, lambda b: b.rlike(r"\S")), lambda b: sample_column(b, 512))


def strip_blocks(page: Column) -> Column:
    """``page`` without script, style, noscript and template elements that hold
    something; for pages that nest none of them."""
    for tag in DROP_TAGS:
        if tag != "meta":
            page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>(?=[^<]*\S)(?!\s*</{tag}).*?</{tag}\s*>", "")
    return page


#: Greek letters that are symbols in ordinary text, and letters
#: that a backslash makes a control character.
GREEK_SYMBOLS = "ΔΘΛΞΣΨΩβδζθλμξπςψω"
ESCAPE_LETTERS = "ntrfvbaeuxsSdDwWpP0"


def mixed_script_words(text: Column) -> Column:
    """(word, detail) of words of three letters or more that mix scripts."""
    heads = F.regexp_replace(text, rf"(?<=\\)[{ESCAPE_LETTERS}](?=\p{{L}})", " ")
    words = F.array_distinct(F.filter(F.regexp_extract_all(heads, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 3))

    def detail(word: Column) -> Column:
        return F.concat_ws(
            "+",
            F.when(word.rlike(r"[\p{IsLatin}\x{1D400}-\x{1D6A5}\x{1D7CE}-\x{1D7FF}]"), "Latin"),
            F.when(word.rlike(r"\p{IsCyrillic}"), "Cyrillic"),
            F.when(word.rlike(rf"(?![{GREEK_SYMBOLS}])\p{{IsGreek}}"), "Greek"),
        )

    found = F.transform(words, lambda w: F.struct(w.alias("word"), detail(w).alias("detail")))
    return F.filter(found, lambda x: F.instr(x["detail"], "+") > 0)


#: Encoded runs.
BASE64 = "[A-Za-z0-9+/_-]{32,}={0,2}"
HEX = "(?<![A-Za-z0-9_])(?:[0-9a-fA-F]{2}){24,}(?![A-Za-z0-9_])"
PERCENT = "(?:%[0-9A-Fa-f]{2}){6,}"
_PROSE_WORD = regex.compile(r"\p{L}{2,}[,.!?;:)]?")
_PROSE_FILLER = regex.compile(r"\p{N}[\p{N}.,]*|\p{L}")
_TEXTY = regex.compile(r"[\p{L}\p{N}\p{Zs}\p{P}\n\r\t]")
_BASE64, _HEX, _PERCENT = (re.compile(p) for p in (BASE64, HEX, PERCENT))

Finding = tuple[str, str, str]


def sample(text: str, most: int = 80) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + chr(0x2026)


def strip_invisible(text: str) -> tuple[str, list[Finding]]:
    """All rules, each on what the one before left."""
    found: list[Finding] = []
    for name, pattern in _RULES:
        hits = [m[0] for m in pattern.finditer(text)]
        if hits:
            points = " ".join(f"U+{ord(h[0]):04X}" for h in hits)
            found.append(("invisible", name, f"{len(hits)} occurrence{'s' * (len(hits) > 1)}: {sample(points, 60)}"))
            text = pattern.sub("", text)
    return text, found


def is_prose(text: str) -> bool:
    """Three words in a row between single spaces, fillers aside."""
    run = 0
    for token in text.split(" "):
        if _PROSE_WORD.fullmatch(token):
            run += 1
            if run >= 3:
                return True
        elif not _PROSE_FILLER.fullmatch(token):
            run = 0
    return False


def _decoded(kind: str, match: str) -> str | None:
    try:
        if kind == "base64":
            plain = match.rstrip("=").translate(str.maketrans("-_", "+/"))
            plain = plain[:-1] if len(plain) % 4 == 1 else plain
            data = base64.b64decode(plain + "=" * (-len(plain) % 4))
        else:
            data = bytes.fromhex(match) if kind == "hex" else unquote_to_bytes(match)
        text = data.decode()
    except ValueError:
        return None
    if len(text) < 8 or chr(0xFFFD) in text:
        return None
    return text if len(_TEXTY.findall(text)) >= 0.9 * len(text) else None


def encoded(text: str, depth: int = 0) -> list[Finding]:
    """Encoded runs that read as speech, or that are layered."""
    if depth > 2:
        return []
    found: list[Finding] = []
    for kind, pattern in (("base64", _BASE64), ("hex", _HEX), ("percent", _PERCENT)):
        past, slash = 0, False  # whether the word so far has a slash
        for m in pattern.finditer(text):
            if kind == "percent":
                *before, last = re.split(r"\s", text[past : m.start()])
                slash, past = "/" in last or (slash and not before), m.end()
                if slash:
                    continue
            inner = _decoded(kind, m[0])
            if inner is None:
                continue
            below = encoded(inner, depth + 1)
            if depth or below or is_prose(inner):
                found.append(("encoded", kind, sample(inner)))
            found += below
    return found


_SCRIPTS = (
    ("Latin", regex.compile(r"[\p{Latin}\U0001D400-\U0001D6A5\U0001D7CE-\U0001D7FF]")),
    ("Cyrillic", regex.compile(r"\p{Cyrillic}")),
    ("Greek", regex.compile(rf"(?![{GREEK_SYMBOLS}])\p{{Greek}}")),
)
_LETTERS = regex.compile(r"\p{L}+")


def mixed_script(text: str) -> list[Finding]:
    """Words that mix scripts, once each."""
    found, seen = [], set()
    for m in _LETTERS.finditer(text):
        word = m[0]
        if m.start() and text[m.start() - 1] == "\\" and word[0] in ESCAPE_LETTERS:
            word = word[1:]
        if len(word) < 3 or word in seen:
            continue
        names = [name for name, pattern in _SCRIPTS if pattern.search(word)]
        if len(names) > 1:
            seen.add(word)
            found.append(("mixed-script", "+".join(names), sample(word)))
    return found


# ---------------------------------------------------------------- HTML

#: Styles that hide, attributes that only machines read, colours.
HIDDEN_STYLE = r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?!\.[1-9])|opacity\s*:\s*0(?!\.[1-9])"
OFFSCREEN_STYLE = (
    r"(?i)text-indent\s*:\s*-\d{3,}|(?:left|top|right|bottom|margin-left|margin-top)\s*:\s*-\d{4,}|clip\s*:\s*rect\(\s*0|clip-path\s*:\s*inset\(\s*100%"
)
MACHINE_ATTRIBUTES = frozenset(
    {"aria-label", "aria-description", "aria-roledescription", "aria-placeholder", "aria-valuetext", "aria-details", "placeholder", "srcdoc", "abbr"}
)
COLOURS = {
    "white": "#ffffff", "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "whitesmoke": "#f5f5f5", "ivory": "#fffff0", "snow": "#fffafa",
}
#: Fixed values of HTML: elements without content, and what a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCKS}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_MASK = chr(0xE000)


@dataclass
class Element:
    tag: str
    start: int
    inner: int
    attributes: dict[str, str]
    spans: dict[str, tuple[int, int]]
    end: int = -1


@dataclass
class _Tag:
    start: int
    end: int
    closing: bool
    name: str
    attributes: dict[str, str]
    spans: dict[str, tuple[int, int]]


class _Scanner:
    """Tags of a page from left to right.

    An attribute's name ends at white space, a slash, an equals sign or the
    tag's end, and its value may be quoted; a quote that is never closed is a
    character like others.  Once a tag has no end outside of its quotes, tags
    end at the next ``>`` whatever its quotes say, so a page is read through no
    more than twice.
    """

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last = {c: source.rfind(c) for c in "\"'>"}

    def next(self, at: int) -> _Tag | None:
        while (m := _TAG.search(self.source, at)) and m.start() < self.last[">"]:
            if (tag := self._read(m)) is not None:
                return tag
            self.quotes = False
            at = m.start()
        return None

    def _read(self, m: re.Match[str]) -> _Tag | None:
        source, at = self.source, m.end()
        values, spans = {}, {}
        while True:
            before = at
            at = _GAP.match(source, at).end()
            if at >= len(source):
                return None
            if source[at] == ">":
                return _Tag(m.start(), at + 1, bool(m[1]), m[2].lower(), values, spans)
            named = _NAME.match(source, at)
            name, at, value = named[0].lower(), named.end(), ""
            equals = _EQUALS.match(source, at)
            if equals:
                at = equals.end()
                quote = source[at : at + 1]
                if self.quotes and quote in ("'", '"') and quote and at < self.last[quote]:
                    closed = source.index(quote, at + 1)
                    value, at = source[at + 1 : closed], closed + 1
                else:
                    bare = _BARE.match(source, at)
                    value, at = bare[0].strip("'\""), bare.end()
            if name not in values:
                values[name], spans[name] = html.unescape(value), (before, at)


def elements(source: str) -> tuple[list[Element], list[tuple[int, int]]]:
    """The elements of a page in order of their start, and where its texts lie."""
    found: list[Element] = []
    texts: list[tuple[int, int]] = []
    open_now: list[Element] = []
    open_tags: Counter[str] = Counter()  # so that stray end tags cost nothing
    at = 0

    def close(upto: int, end: int, last: int) -> None:
        while len(open_now) > upto:
            closed = open_now.pop()
            open_tags[closed.tag] -= 1
            closed.end = end if len(open_now) > upto else last

    tags = _Scanner(source)
    while (m := tags.next(at)) is not None:
        if m.start > at:
            texts.append((at, m.start))
        at, tag = m.end, m.name
        if m.closing:
            if open_tags[tag] > 0:
                close(next(k for k in range(len(open_now) - 1, -1, -1) if open_now[k].tag == tag), m.start, m.end)
            continue
        while open_now and open_now[-1].tag in ENDS.get(tag, ()):
            close(len(open_now) - 1, m.start, m.start)
        element = Element(tag, m.start, m.end, m.attributes, m.spans)
        found.append(element)
        if tag in VOID:
            element.end = m.end
            continue
        open_now.append(element)
        open_tags[tag] += 1
        if tag in ("script", "style"):
            done = re.compile(rf"</{tag}\b", re.I).search(source, at)
            stop = done.start() if done else len(source)
            if stop > at:
                texts.append((at, stop))
            at = stop
    if len(source) > at:
        texts.append((at, len(source)))
    close(0, len(source), len(source))
    return found, texts


def _payload(e: Element, source: str, texts: list[tuple[int, int]]) -> str:
    """The text in an element, or what its content or value attribute says."""
    first, last = bisect_left(texts, (e.inner, 0)), bisect_left(texts, (e.end, 0))
    said = [html.unescape(source[a:b]) for a, b in texts[first:last]]
    return "".join(said) or e.attributes.get("content", "") or e.attributes.get("value", "")


_HEX_COLOUR = re.compile(r"#(?:(?P<short>[0-9a-f]{3})(?P<a>[0-9a-f])?|(?P<long>[0-9a-f]{6})(?P<aa>[0-9a-f]{2})?)")
_CHANNEL = r"([0-9]{1,6}(?:\.[0-9]{0,6})?|\.[0-9]{1,6})%?"
_RGB_COLOUR = re.compile(rf"rgba?\([\s,/]*{_CHANNEL}[\s,/]+{_CHANNEL}[\s,/]+{_CHANNEL}(?:[\s,/]+([^\s,/)]+)[^)]*)?[\s,/]*\)")
_NOTHING = re.compile(r"[+-]?(?:0+\.?0*|\.0+)(?:e[+-]?[0-9]+)?")


def colour(raw: str | None) -> str | None:
    """``#rrggbb``, ``transparent``, or None for what is no colour.

    Numbers are read by their pattern, so what isn't one is no colour; an alpha
    of zero is one without a per cent sign.
    """
    value = (raw or "").strip().lower()
    if value == "transparent":
        return value
    if value in COLOURS:
        return COLOURS[value]
    if m := _HEX_COLOUR.fullmatch(value):
        if (m["a"] or m["aa"] or "f").strip("0") == "":
            return "transparent"
        return "#" + (m["long"] or "".join(2 * c for c in m["short"]))
    if m := _RGB_COLOUR.fullmatch(value):
        if m[4] and _NOTHING.fullmatch(m[4]):
            return "transparent"
        return "#" + "".join(format(int(float(n) + 0.5), "02x") for n in m.groups()[:3])
    return None


def _declared(style: str) -> dict[str, str]:
    pairs = (part.partition(":") for part in style.split(";"))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def unseen_colour(style: str, page_has_background: bool) -> bool:
    """Text in its background's colour, transparent, or near white on nothing."""
    said = _declared(style)
    own = colour(said.get("color"))
    if own in (None, "transparent"):
        return own is not None
    shorthand = said.get("background", "")
    known = (colour(text) for text in (said.get("background-color"), shorthand, *shorthand.split()))
    behind = next((found for found in known if found), None)
    if behind:
        return behind == own
    light = [int(own[k : k + 2], 16) >= 0xF0 for k in (1, 3, 5)] if len(own) == 7 else [False]
    return all(light) and not page_has_background


def _hidden(e: Element, page_has_background: bool) -> bool:
    if not e.attributes:
        return False
    style = e.attributes.get("style", "")
    return (
        "hidden" in e.attributes
        or e.attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(re.search(HIDDEN_STYLE, style) or re.search(OFFSCREEN_STYLE, style))
        or unseen_colour(style, page_has_background)
    )


def _for_machines(e: Element, name: str) -> bool:
    value = e.attributes[name]
    machine = name in MACHINE_ATTRIBUTES or name.startswith("data-")
    machine = machine or (e.tag == "input" and name == "value" and e.attributes.get("type", "").strip().lower() == "hidden")
    return machine and bool(re.search(r"[A-Za-z0-9_]\s+[A-Za-z0-9_]", value) or len(value.strip()) >= 40)


def _without_comments(page: str) -> tuple[str, list[str]]:
    kept, bodies, at = [], [], 0
    while (start := page.find("<!--", at)) >= 0 and (end := page.find("-->", start + 4)) >= 0:
        kept.append(page[at:start])
        bodies.append(page[start + 4 : end])
        at = end + 3
    return "".join([*kept, page[at:]]), bodies


def strip_html(page: str) -> tuple[str, list[Finding]]:
    """``page`` without comments, hidden elements and machine-only text; the
    other bytes stay as they are."""
    if "<" not in page:
        return page, []
    source, bodies = _without_comments(page)
    found: list[Finding] = [("hidden-html", "comment", sample(b, 512)) for b in bodies if b.strip()]
    if _MASK not in source:  # a raw tag that is never closed is a mention, not an element
        for tag in ("script", "style", "noscript", "template"):
            if not re.search(rf"(?i)</{tag}\b", source):
                source = re.sub(rf"(?i)<(?={tag}\b)", _MASK, source)
    background = bool(re.search(r"(?i)background(-color)?\s*:|bgcolor\s*=", page))
    cuts: list[tuple[int, int]] = []
    gone = -1
    found_elements, texts = elements(source)
    for e in found_elements:
        if e.start < gone:  # inside what went
            continue
        reason, payload = None, ""
        if e.tag in DROP_TAGS:
            payload = _payload(e, source, texts)
            reason = f"tag:{e.tag}" if payload.strip() else None
        elif _hidden(e, background):
            reason, payload = "hidden-element", _payload(e, source, texts)
        if reason:
            found.append(("hidden-html", reason, sample(payload, 512)))
            cuts.append((e.start, e.end))
            gone = e.end
        elif e.tag not in DROP_TAGS:
            found += [("annotation", f"attr:{a}", sample(e.attributes[a])) for a in ("alt", "title") if e.attributes.get(a, "").strip()]
            for name in e.attributes:
                if _for_machines(e, name):
                    found.append(("hidden-html", f"attr:{name}", sample(e.attributes[name], 512)))
                    cuts.append(e.spans[name])
    kept, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            kept.append(source[at:a])
            at = b
    kept.append(source[at:])
    return "".join(kept).replace(_MASK, "<"), [(k, d, s.replace(_MASK, "<")) for k, d, s in found]


def sanitize_text(text: str) -> tuple[str, list[Finding]]:
    """The clean text and its findings: invisible, HTML, mixed scripts, encoded."""
    clean, unseen = strip_invisible(text)
    clean, markup = strip_html(clean)
    whole = "\n".join([clean, *(s for _, _, s in markup)])
    return clean, [*unseen, *markup, *mixed_script(whole), *encoded(whole)]


FINDINGS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "detail", "sample")]))
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("detail", pa.string()), ("sample", pa.string())]))


_CLEANED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("findings", FINDINGS)])
#: What a text must have for any rule to fire: markup, a character beyond
#: printable ASCII, or a run that may be encoded.
_SUSPECT = r"<|[^\t\n\r\x20-\x7E]|[A-Za-z0-9+/_-]{32}|(?:%[0-9A-Fa-f]{2}){6}"


def sanitize(text: Column | str) -> Column:
    """(clean, findings) of each text; null for null.

    A text that no rule can concern never leaves the engine.
    """
    text = F.col(text) if isinstance(text, str) else text
    suspect = text.rlike(_SUSPECT)
    plain = F.struct(text.alias("clean"), F.array().cast(FINDINGS).alias("findings"))
    return F.when(suspect, _sanitized(F.when(suspect, text))).when(text.isNotNull(), plain)


@F.arrow_udf(_CLEANED)
def _sanitized(texts: pa.Array) -> pa.Array:
    results = [None if t is None else sanitize_text(t) for t in texts.to_pylist()]
    rows = [None if r is None else {"clean": r[0], "findings": [dict(zip(("kind", "detail", "sample"), f, strict=True)) for f in r[1]]} for r in results]
    return pa.array(rows, pa.struct([("clean", pa.string()), ("findings", _FINDING)]))


def removing(findings: Column) -> Column:
    """Findings that removed something."""
    return F.filter(findings, lambda f: f["kind"].isin("invisible", "hidden-html"))
