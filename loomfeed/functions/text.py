"""Text, date, hash, JSON and number functions: Column -> Column, all inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interface phrases that pages print around comments, longest first where one holds another.
OPERATION_TEXTS = ("查看全部回答", "查看全部", "查看更多", "展开", "收起", "更多", "追评", "默认好评")
UNIT_SEPARATOR = "\u001f"
#: Formats that dates are tried in, in this order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd")
# Fixed value: what may stand between the characters of a term, spaces and punctuation, as the inside of a character class.
_JOINERS = r"\s\u00a0\u200b-\u200d\ufeff·・•.\-_—–/\\|:：,，、\[\]【】()（）{}《》<>「」『』\"“”'’`"
#: The same, character by character: white space and punctuation lie in these ranges.
_JOINER_CHARS = "".join(c for c in map(chr, (*range(0x100), *range(0x2000, 0x2100), *range(0x3000, 0x3100), *range(0xFE00, 0x10000))) if re.match(f"(?a:[{_JOINERS}])", c))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def truthy(c: Column) -> Column:
    """Spreadsheet booleans: 1, true, yes and y; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "1.0"), F.lit(False))


def remove_invalid_xml_chars(c: Column) -> Column:
    """TXT1: without C0 controls other than tab and line ends, and without U+FFFE and U+FFFF."""
    return F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")


def clean_text(c: Column) -> Column:
    """TXT2: without interface phrases, lines of dots and surplus white space (fixed patterns)."""
    steps = [(r"\u200b", ""), (r"\u00a0", " "), *((f"(?iu){re.escape(t)}", " ") for t in OPERATION_TEXTS), (r"(?m)^\s*(?:\.{3,}|…+)\s*$", " "), (r"[ \t\f\x0B]+", " "), (r"\s*\n\s*", "\n"), (r"\n{2,}", "\n")]
    return F.btrim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, remove_invalid_xml_chars(c)), F.lit(" \t\r\n|"))


def split_visible_lines(c: Column) -> Column:
    """TXT3: cleaned lines that are not empty."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"[\r\n]+"), clean_text), lambda x: (x != "") & ~x.isin(*OPERATION_TEXTS))


def normalize(c: Column) -> Column:
    """TXT4: white space (Unicode) collapsed, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " ")))


def md5_of(*parts: Column) -> Column:
    """TXT5: md5 of the parts as they are; null is empty."""
    return F.md5(F.concat_ws(UNIT_SEPARATOR, *map(text_or_empty, parts)))


def sha256_of(*parts: Column) -> Column:
    """TXT5: sha256 of the normalized parts."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *map(normalize, parts)), 256)


def term_pattern(term: str) -> str:
    """TXT6: the term with any run of spaces and punctuation between its characters; case counts unless it has Latin letters."""
    letters = [re.sub(r"([^\w])", r"\\\1", c) for c in re.sub(r"\s+", "", term)]
    return ("(?iu)" if re.search("[A-Za-z]", term) else "") + f"[{_JOINERS}]*".join(letters)


def squeeze(text: Column) -> Column:
    """The text without anything that may stand between the characters of a term."""
    return F.translate(text_or_empty(text), _JOINER_CHARS, "")


def term_matches(text: Column, term: str, squeezed: Column | None = None) -> Column:
    """TXT6.  With the squeezed text a term is a plain substring; one that itself has such characters needs its pattern."""
    own = re.sub(r"\s+", "", term)
    if squeezed is None or re.search(f"[{_JOINERS}]", own):
        return text.rlike(term_pattern(term))
    return F.lower(squeezed).contains(own.lower()) if re.search("[A-Za-z]", own) else squeezed.contains(own)


def latin_token(text: Column, token: str = "AI", before: tuple[str, ...] = (), after: tuple[str, ...] = (), lower: Column | None = None) -> Column:
    """TXT7: the token outside Latin words, or behind one of `before`, or in front of one of `after`.  It is sought where the text
    holds its letters at all."""
    own = f"(?:{token}|{token.lower()})"
    parts = [rf"(?<![A-Za-z])(?:{token}|{token.lower()}|{re.escape('.'.join(token) + '.')})(?![A-Za-z])"]
    parts += [f"(?:{'|'.join(before)}){own}"] if before else []
    parts += [f"{own}(?:{'|'.join(after)})"] if after else []
    lower = F.lower(text) if lower is None else lower
    some = lower.contains(token.lower()) | lower.contains(".".join(token.lower()) + ".")
    return F.when(some, text.rlike("|".join(parts))).otherwise(F.lit(False))


def match_terms(text: Column, terms: list[str] | tuple[str, ...], squeezed: Column | None = None) -> Column:
    """TXT8: the terms that match, in their order, each once."""
    hits = [F.when(term_matches(text, t, squeezed), F.lit(t)) for t in dict.fromkeys(terms)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def drop_contained(terms: Column) -> Column:
    """TXT8: terms, longest first, without those that an earlier kept one holds (whatever the case)."""
    kept = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y).contains(F.lower(x))), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(terms, F.array().cast("array<string>"), kept)


def compact(c: Column) -> Column:
    """Lower case, without white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def matched_sentence(text: Column, terms: Column, window: int = 80) -> Column:
    """TXT9: short texts whole; else the sentences that hold a term; else a window about the first term; else the start.  Each
    sentence and each term is made compact once."""
    sentences = F.filter(F.transform(F.split(text, r"[。！？!?；;\r\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    pairs = F.transform(sentences, lambda s: F.struct(s.alias("s"), compact(s).alias("c")))
    # An array of one element binds what is used more than once to a name.
    bound = F.array(F.struct(F.transform(terms, compact).alias("t"), pairs.alias("p"), compact(text).alias("c")))
    holding = F.array_distinct(F.flatten(F.transform(bound, lambda b: F.transform(F.filter(b["p"], lambda x: F.exists(b["t"], lambda t: x["c"].contains(t))), lambda x: x["s"]))))
    places = F.flatten(F.transform(bound, lambda b: F.filter(F.transform(b["t"], lambda t: F.instr(b["c"], t) - 1), lambda i: i >= 0)))
    about = F.get(F.transform(F.array(places), lambda p: F.when(F.size(p) > 0, F.substring(text, F.greatest(F.array_min(p) - window // 2, F.lit(0)) + 1, F.lit(window))).otherwise(F.substring(text, 1, window))), F.lit(0))
    long = F.get(F.transform(F.array(holding), lambda h: F.when(F.size(h) > 0, F.array_join(h, " || ")).otherwise(about)), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.length(text) <= window, text).when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.substring(text, 1, window)).otherwise(long)


def split_terms(c: Column) -> Column:
    """TXT10: the trimmed, non-empty parts between commas, bars and semicolons."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"[,，|、;]"), lambda x: F.trim(x)), lambda x: x != "")


def source_file_name(c: Column) -> Column:
    """TXT11: the last component of a path with either slash."""
    return F.element_at(F.split(text_or_empty(c), r"[\\/]+"), -1)


def find_quote(text: Column, quote: Column) -> Column:
    """TXT14: where text holds the quote but for white space, the substring of text; else null.  Only where it does, the text is
    cut into characters, once, and the places of those that are not white space tell where the match begins and ends."""
    squeezed = lambda c: F.regexp_replace(text_or_empty(c), r"(?U)\s+", "")
    at, n = F.instr(squeezed(text), squeezed(quote)), F.length(squeezed(quote))
    solid = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"(?U)\S"), i + 1)), lambda i: i.isNotNull())
    found = F.transform(F.array(solid), lambda p: F.substring(text, F.get(p, at - 1), F.get(p, at + n - 2) - F.get(p, at - 1) + 1))
    return F.when((n > 0) & (at > 0), F.get(found, F.lit(0)))


def parse_time(*columns: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """DT3: the first of the columns that reads as a time, in fixed formats."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c.cast("string")), F.lit(f)) for c in columns for f in formats))


def review_date(c: Column) -> tuple[Column, Column]:
    """DT1: the date as written and as yyyy-MM-dd; empty where there is none, or where the calendar has none."""
    pattern = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    day = F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d"))
    return F.regexp_extract(text_or_empty(c), pattern, 0), F.when(y != "", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))).otherwise("")


def strict_seconds(c: Column) -> Column:
    """DT2: a time in whole seconds; text that is no time raises."""
    return F.date_trunc("second", F.to_timestamp(c))


def latest_minute(c: Column) -> Column:
    """DT4, an aggregate: the latest parsed time as yyyy-MM-dd HH:mm; empty if there is none."""
    return F.coalesce(F.date_format(F.max(parse_time(c)), "yyyy-MM-dd HH:mm"), F.lit(""))


def json_lines(c: Column) -> Column:
    """JS1: the trimmed lines that look like objects."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("{") & x.endswith("}"))


def input_hash(*parts: Column) -> Column:
    """JS3: sha256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *map(text_or_empty, parts)), 256)


def safe_rate(x: Column, y: Column) -> Column:
    """NUM1: x / y, and 0 where y is 0."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def as_number(c: Column) -> Column:
    """Numbers as spreadsheets hold them: what does not read as one is 0."""
    return F.coalesce(F.expr("NULL").cast("double") if c is None else c.try_cast("double"), F.lit(0.0))


def product_reference(c: Column) -> tuple[Column, Column]:
    """URL1: platform and item id of the first marketplace link in a text; empty where there is none."""
    link = F.regexp_replace(F.regexp_extract(text_or_empty(c), r"(?i)(https?://[^\s<>\"'，。；]*(?:tmall|taobao)\.com[^\s<>\"'，。；]*)", 1), r"[.,;!?)\]}）】》]+$", "")
    host = F.lower(F.coalesce(F.regexp_extract(link, r"(?i)^https?://([^/?#:]+)", 1), F.lit("")))
    platform = F.when(host.rlike(r"(^|\.)tmall\.com$"), "tmall").when(host.rlike(r"(^|\.)taobao\.com$"), "taobao").otherwise("")
    item = F.coalesce(*(F.nullif(F.regexp_extract(link, p, 1), F.lit("")) for p in (r"[?&]id=(\d+)(?=&|#|$)", r"[?&](?:itemId|item_id)=(\d+)(?=&|#|$)", r"/i(\d+)\.htm")), F.lit(""))
    return platform, F.when(platform != "", item).otherwise("")
