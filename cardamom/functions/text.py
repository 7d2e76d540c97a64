"""Text helpers as Column expressions; Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import difflib
import heapq
import re
import unicodedata
from collections import Counter
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms that fold to ASCII (CJK punctuation stays).
WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
# All blanks of Unicode, for a character class.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def normal_form(form: str):
    """Unicode normalization (NFC, NFKC, NFD or NFKD) of a column."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return fold


def normalize_text(text: Column) -> Column:
    """Full-width letters and digits to ASCII, blanks (ideographic too) to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, WIDE, NARROW), r"[\s　]+", " "))


def join_hyphenated(text: Column) -> Column:
    """Words broken by a hyphen at a line end become whole again if a lower-case letter follows; other line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"[-‐‑]\n(?=\p{Ll})", ""), "\n", " ")


# Forms that no rule gives, and function words that print or recognition glues to a word, before it and behind it.
IRREGULAR = {"bear": ["bore", "born", "borne"], "hypothesis": ["hypotheses"], "mean": ["meant"]}
GLUED_BEFORE = ("the this that these those and for from with into very extremely really their your our are was were have has had can will would").split()
GLUED_BEHIND = ("the that this these those and for from with into of to in on at by as is are was were have has had all more not it its our their").split()


def headword_alternatives(head: Column) -> Column:
    """The spellings of a headword in lower case: parts between slashes, ``-suffix`` in place of the end of the part before, each without and with what is in parentheses; letters only."""
    parts = F.split(F.lower(F.trim(head)), "/")
    start = F.struct(F.lit("").alias("before"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, part: Column) -> Column:
        suffix = F.startswith(part, F.lit("-"))
        replaced = F.concat(F.substr(s["before"], F.lit(1), F.length(s["before"]) - F.length(part) + 1), F.substr(part, F.lit(2)))
        own = F.when(suffix & (F.length(s["before"]) > F.length(part) - 1), replaced).otherwise(part)
        return F.struct(F.when(suffix, s["before"]).otherwise(part).alias("before"), F.concat(s["out"], F.array(own)).alias("out"))

    letters = lambda x: F.regexp_replace(x, "[^a-z]", "")
    both = F.flatten(F.transform(F.aggregate(parts, start, step, lambda s: s["out"]), lambda x: F.array(letters(F.regexp_replace(x, r"\([a-z]+\)", "")), letters(x))))
    return F.array_remove(F.array_distinct(both), "")


def headword_forms(head: Column) -> Column:
    """array<string> of the forms of a headword to look for: its alternatives with s, es, ed and ing; e dropped, y changed and the last consonant doubled where they are; irregular ones. Null for null."""

    def forms(base: Column) -> Column:
        stem, last = F.left(base, F.length(base) - 1), F.right(base, F.lit(1))
        plain = F.array(base, *[F.concat(base, F.lit(x)) for x in ("s", "es", "ed", "ing")])
        none = F.array().cast("array<string>")
        e = F.when(last == "e", F.array(F.concat(stem, F.lit("ing")), F.concat(base, F.lit("d")))).otherwise(none)
        y = F.when((last == "y") & (F.length(base) > 1), F.array(F.concat(stem, F.lit("ies")), F.concat(stem, F.lit("ied")))).otherwise(none)
        double = F.when(base.rlike("[^aeiou][aeiou][^aeiouwxy]$"), F.array(F.concat(base, last, F.lit("ed")), F.concat(base, last, F.lit("ing")))).otherwise(none)
        return F.concat(plain, e, y, double)

    irregular = F.create_map(*[x for k, v in IRREGULAR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(irregular, F.lower(F.trim(head))), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.flatten(F.transform(headword_alternatives(head), forms)), own))


def text_has_headword(text: Column, forms: Column) -> Column:
    """Does a form stand in the text: as a word; inside a word if it has 5 letters or more; or, from 3 letters on, where the word goes on with function words only.

    Words are runs of a-z in lower case; those that a hyphen breaks at a blank or line end are joined first, and ``'s`` before letters is a word's end. False
    for texts without words; null for null.
    """
    whole = F.regexp_replace(F.regexp_replace(text, r"(?i)([a-z])-\s+(?=[a-z])", "$1"), r"(?i)([a-z]{3,})['’]s(?=[a-z]{3,})", "$1's ")
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(whole), F.lit("[a-z]+"), F.lit(0)), " "), F.lit(" "))
    before, behind = "(?: |" + "|".join(GLUED_BEFORE) + ")", "(?: |" + "|".join(GLUED_BEHIND) + ")"

    def stands(f: Column) -> Column:
        glued = F.rlike(words, F.concat(F.lit(before), f, F.lit(behind))) | ((F.length(f) >= 4) & F.rlike(words, F.concat(f, F.lit(behind.replace(" |", "", 1)))))
        return F.contains(words, f) & ((F.length(f) >= 5) | F.contains(words, F.concat(F.lit(" "), f, F.lit(" "))) | ((F.length(f) >= 3) & glued))

    return F.exists(forms, lambda f: (f != "") & stands(f))


def phrase_forms(head: Column) -> Column:
    """Forms of a head of one word or several to look for: itself, without an optional part in parentheses, plural, past and -ing forms of its end."""
    low = F.lower(F.trim(head))
    bare = F.trim(F.regexp_replace(low, r"\([^)]*\)", ""))
    stem = F.regexp_replace(bare, "e$", "")
    double = F.concat(bare, F.right(bare, F.lit(1)))
    y_stem = F.when(bare.rlike("[^aeiou]y$"), F.regexp_replace(bare, "y$", "i"))
    forms = [low, bare, F.concat(bare, F.lit("s")), F.concat(bare, F.lit("es")), F.concat(bare, F.lit("ed")), F.concat(bare, F.lit("ing")),
             F.concat(stem, F.lit("ed")), F.concat(stem, F.lit("ing")), F.concat(double, F.lit("ed")), F.concat(double, F.lit("ing")),
             F.concat(y_stem, F.lit("es")), F.concat(y_stem, F.lit("ed"))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def target_span(text: Column, forms: Column) -> Column:
    """struct<start, end> of the first longest form that stands in the text (from 0, end exclusive); null if none does."""
    low = F.lower(text)
    found = F.filter(forms, lambda f: F.contains(low, f))
    best = F.get(F.array_sort(F.transform(found, lambda f: F.struct((-F.length(f)).alias("n"), F.instr(low, f).alias("at")))), 0)
    return F.when(F.size(found) > 0, F.struct((best["at"] - 1).alias("start"), (best["at"] - 1 - best["n"]).alias("end")))


def split_en_zh(text: Column) -> Column:
    """struct<en, zh>: the text before and from its first CJK character."""
    cjk = r"[一-鿿]"
    return F.struct(
        F.trim(F.regexp_extract(text, rf"^((?:(?!{cjk}).)*)", 1)).alias("en"), F.trim(F.regexp_extract(text, rf"({cjk}.*)$", 1)).alias("zh"))


def split_pos_gloss(text: Column) -> Column:
    """array<struct<pos, gloss>> of a gloss line such as ``n. hall v. to enter``."""
    parts = F.regexp_extract_all(text, F.lit(r"((?:n|v|adj|adv|prep|conj|pron)\.\s*.*?)(?=\s+(?:n|v|adj|adv|prep|conj|pron)\.|$)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)\.", 1).alias("pos"), F.trim(F.regexp_replace(p, r"^\w+\.\s*", "")).alias("gloss")))


def close_spelling(a: Column, b: Column) -> Column:
    """Edit distance of at most 1, or 2 from six letters on, with the same first letter."""
    allowed = F.when(F.least(F.length(a), F.length(b)) >= 6, 2).otherwise(1)
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.levenshtein(a, b) <= allowed)


def is_additive_space(old: Column, new: Column) -> Column:
    """Does the new text only add spaces?"""
    bare = lambda x: F.regexp_replace(x, " ", "")
    return (bare(old) == bare(new)) & (F.length(new) > F.length(old))


_WORD = re.compile(r"\S+")


def with_spaces(original: str | None, *readings: str | None) -> str | None:
    """The original with spaces where merge_spaces puts them. A text is compared by the numbers of characters up to its words' ends; work grows with its length."""
    if original is None or None in readings:
        return None
    own, read = original.split(), [r.split() for r in readings]
    letters = "".join(own)
    if any("".join(words) != letters for words in read):
        return None
    wanted = set.intersection(*[set(accumulate(map(len, words))) for words in read]).difference(accumulate(map(len, own)))
    new = sorted(p for p in wanted if (pair := letters[p - 1 : p + 1]).isascii() and pair.isalpha())
    pieces, done, before, k = [], 0, 0, 0
    for word in _WORD.finditer(original) if new else ():
        while k < len(new) and new[k] < before + word.end() - word.start():
            at = word.start() + new[k] - before
            pieces += [original[done:at], " "]
            done, k = at, k + 1
        before += word.end() - word.start()
    return "".join([*pieces, original[done:]])


def merge_spaces(original: Column, first: Column, second: Column | None = None) -> Column:
    """The original with a space wherever the reading (with two, both of them) has blanks between two ASCII letters and the original has none.

    Null unless all have the same characters apart from blanks, or if one is null. The original's own blanks stay as they are.
    """

    @F.arrow_udf("string")
    def merged(texts: pa.Array, one: pa.Array) -> pa.Array:
        return pa.array(map(with_spaces, texts.to_pylist(), one.to_pylist()), pa.string())

    @F.arrow_udf("string")
    def merged_by_both(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(map(with_spaces, texts.to_pylist(), one.to_pylist(), two.to_pylist()), pa.string())

    return merged(original, first) if second is None else merged_by_both(original, first, second)


def overlap(a: str, b: str) -> int:
    """Length of the longest end of a that begins b."""
    most, head = min(len(a), len(b)), b[:8]
    at = a.find(head, len(a) - most) if most >= len(head) else -1
    for _ in range(64):
        if at < 0:
            return next((n for n in range(min(most, len(head) - 1), 0, -1) if a.endswith(b[:n])), 0)
        if b.startswith(a[at:]):
            return len(a) - at
        at = a.find(head, at + 1)
    # The beginning comes again and again: by borders of b, in proportion to the lengths.
    border, n = [0], 0
    for ch in b[1:most]:
        while n and b[n] != ch:
            n = border[n - 1]
        n += b[n] == ch
        border.append(n)
    n = 0
    for k, ch in enumerate(a[len(a) - most :], 1):
        while n and (n == most or b[n] != ch):
            n = border[n - 1]
        n += b[n] == ch
    return n


def joined_by_overlap(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return None
    a, b = a.rstrip(), b.lstrip()
    n = overlap(a, b) if a and b else 0
    word = lambda c: unicodedata.category(c)[0] in "LN"
    return a + (" " if not n and a and b and word(a[-1]) and word(b[0]) else "") + b[n:]


def join_overlapping(left: Column, right: Column) -> Column:
    """Two readings as one text: the longest end of the first that begins the second stands once; without one, a blank between letters or digits. Null if one is null."""

    @F.arrow_udf("string")
    def joined(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(map(joined_by_overlap, one.to_pylist(), two.to_pylist()), pa.string())

    return joined(left, right)


def is_prefix_trim(old: Column, new: Column) -> Column:
    return F.startswith(old, new) & (old != new)


def similarity_ratio(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks of two texts."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(left, right)], dtype="float64")

    return ratio(a, b)


def _longest_match(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block, earliest in a, then in b; by a suffix automaton of b."""
    step, link, length, end = [{}], [-1], [0], [-1]
    last = 0
    for at, ch in enumerate(b):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(at)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = new
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best, state, n = (0, 0, 0), 0, 0
    for at, ch in enumerate(a):
        while state and ch not in step[state]:
            state = link[state]
            n = length[state]
        if ch in step[state]:
            state = step[state][ch]
            n += 1
            if n > best[2]:
                best = (at - n + 1, end[state] - n + 1, n)
    return best


def ratio_reaches(a: str | None, b: str | None, threshold: float) -> bool:
    """Is difflib's ratio of the two texts at least the threshold?

    The blocks are difflib's. What is still open can match by no more than its common characters, so most pairs are decided early.
    """
    a, b = a or "", b or ""
    if a == b:
        return 1.0 >= threshold
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / total < threshold:
        return False

    def most(x: str, y: str) -> int:
        return sum((Counter(x) & Counter(y)).values())

    sure, bound = 0, most(a, b)
    open_ = [(-bound, a, b)]
    while open_ and 2.0 * bound / total >= threshold > 2.0 * sure / total:
        had, x, y = heapq.heappop(open_)
        i, j, n = _longest_match(x, y)
        bound += had
        if n:
            sure, bound = sure + n, bound + n
            for part in ((x[:i], y[:j]), (x[i + n :], y[j + n :])):
                can = most(*part)
                if can:
                    bound += can
                    heapq.heappush(open_, (-can, *part))
    return 2.0 * sure / total >= threshold


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Does the similarity ratio of two texts reach the threshold?"""

    @F.pandas_udf("boolean")
    def reaches(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio_reaches(x, y, threshold) for x, y in zip(left, right)], dtype="bool")

    return reaches(a, b)


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as single hyphens, marks removed."""
    folded = F.regexp_replace(normal_form("NFKD")(text), r"\p{M}", "")
    return F.regexp_replace(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "-"), "^-|-$", "")


def target_ordinal(key: Column) -> Column:
    """The number at the end of a key, null if there is none."""
    return F.nullif(F.regexp_extract(key, r"\.(\d+)$", 1), F.lit("")).cast("int")


def field_path(path: Column) -> Column:
    """struct<index, field> of ``explanations[i].field``; null parts if it has another form."""
    pattern = r"^explanations\[(\d+)\]\.(\w+)$"
    return F.struct(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int").alias("index"), F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).alias("field"))


def digit_candidates(n: Column) -> Column:
    """Numbers that n may be when read upside down or backwards, n first."""
    s = n.cast("string")
    turned = F.translate(F.reverse(s), "69", "96")
    usable = F.when(~s.rlike("[23457]"), turned)
    return F.array_distinct(F.array_compact(F.array(n.cast("int"), F.reverse(s).cast("int"), usable.cast("int"))))
