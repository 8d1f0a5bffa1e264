"""A linear-time necessary test per text, so that only texts that may have a hit meet the cascade.

For every entry of a lexicon one RE2 pattern allows whatever the folds may undo: stand-ins, signs
between letters, repeated letters, noise. It finds at least what the exact layers find in any of
the forms of a message; a text without a match has no hit. Patterns run over whole Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from modspark.functions import text as T
from modspark.operators import lexicon as L

LISTED, EVASIVE, INSERTED, PERSONAL, LINK = 1, 2, 4, 8, 16
WORDS = LISTED | EVASIVE | INSERTED
#: Terms that share a pattern (disguised ones need more states), and terms beyond which every text is taken for a suspect.
TOGETHER, FEW, MOST = 64, 4, 2000

_APART = r"[^a-zA-Z0-9\x{600}-\x{6ff}]*"
_BEFORE, _AFTER = r"(?:^|[^a-zA-Z0-9])", r"(?:$|[^a-zA-Z0-9])"
_ARABIC_FOLD = {**dict(zip(map(ord, "أإآٱىئةؤ"), "ااااييهو")), **dict.fromkeys(map(ord, T.ZERO_WIDTH + T.ARABIC_MARKS + T.TATWEEL))}
_LOOKALIKES = {ord(a): b for a, b in zip(*(x + y for x, y in zip(T.CYRILLIC_LOOKALIKES, T.GREEK_LOOKALIKES)))}
_ZERO_WIDTH = dict.fromkeys(map(ord, T.ZERO_WIDTH))
_RUN = re.compile(r"([^\n])\1{2,}")
#: A letter that normalising, a look-alike, the Arabic fold or lower-casing may change.
_CHANGED = (r"[^\x{0}-\x{9f}\x{a1}-\x{a7}\x{a9}\x{ab}\x{ac}\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{12f}\x{131}\x{134}-\x{13e}"
            r"\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{2af}]")
_PHONE = r"[0-9]{2}\)?[-.\s\x0b]?[0-9]{3}"
_PERSONAL = (
    _PHONE, r"@[A-Za-z0-9.-]+\.[A-Za-z]{2}", r"(?i:my name is|i am called|this is)[\s\x0b]+[A-Za-z]", r"i['’]?m[\s\x0b]+[A-Z][a-z]",
    r"(?i:my age is|i am|i'm)[\s\x0b]+[0-9]",
    r"(?:اسمي|اسمى|معكم|معاكو|الطالب|الطالبة|عمري|عمرى|سني|سنى|ساكن في|ساكن فى|عايش في|عايش فى|عنواني|عنوانى|منطقة|محافظة|شارع)[\s\x0b]")
_LINK = (
    r"(?i)https?://|ftp://|t\.me/|telegram\.me/|discord(?:\.gg|app\.com/invite)/|chat\.whatsapp\.com/|wa\.me/"
    r"|[a-zA-Z0-9-]\.(?:com|org|net|edu|gov|io|ai|me|ly|gl|app|dev|xyz|site|online|top|info|link|store|tech|ru|cn|eg|sa|ae|uk|de|fr|us)"
    r"|[0-9](?:\.[0-9]{1,3}){3}|@[a-zA-Z0-9_]{3}")


def _sources(letter: str, *more: str) -> str:
    """What a letter of some form may have been in the message."""
    singles = {letter, *more} | {a for table in (T.LEET, T.LATIN_ARABIC_DIGITS) for a, b in zip(*table) if b == letter}
    pairs = [re.escape(a) for a, b in T.LATIN_ARABIC_PAIRS if b == letter]
    one = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(singles)) + "]"
    return f"(?:{'|'.join([one, *pairs])})" if pairs else one


def _spread(letters: list[str], apart: str) -> str:
    """The letters in order, each repeated at will, ``apart`` between any two."""
    return "".join(f"(?:{x}{apart})+" for x in letters[:-1]) + letters[-1]


def word_patterns(lex: L.Lexicon) -> dict[int, list[str]] | None:
    """Per bit, patterns for every hit by a term; None where a term gives nothing to look for, or terms are too many."""
    if len(lex.entries) > MOST or any(not e.squeezed for e in lex.entries) or any(not e.folded.isascii() for e in lex.critical()):
        return None
    listed = [_spread([_sources(c) for c in w], _APART) for w in sorted({L._collapse(e.squeezed.lower()) for e in lex.entries})]
    evasive = [_BEFORE + _spread([_sources(c, "*") for c in e.folded], "[^a-zA-Z]*") + "+" + _AFTER for e in lex.critical()]
    inserted = [_BEFORE + ".{0,3}".join(_sources(c) for c in e.folded) + _AFTER for e in lex.critical()]
    return {bit: ["(?is)" + "|".join(bodies[i:i + n]) for i in range(0, len(bodies), n)]
            for bit, bodies, n in ((LISTED, listed, TOGETHER), (EVASIVE, evasive, FEW), (INSERTED, inserted, FEW))}


def _with_runs(texts: pa.Array) -> set[int]:
    """Texts that hold some letter three times in a row; read off the UTF-8 bytes."""
    if not texts.buffers()[2]:
        return set()
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    same = data[1:] == data[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    found = [at[(data[at] < 0x80) & (data[at] != 10)]]
    first = np.flatnonzero(data >= 0xC0)
    for size in (2, 3, 4):
        at = first[first + 3 * size <= len(data)]
        for k in range(2 * size):
            at = at[data[at + k] == data[at + k + size]]
        found.append(at)
    return set((np.searchsorted(ends, np.concatenate(found) + ends[0], "right") - 1).tolist())


def _capped(text: str) -> str:
    return _RUN.sub(r"\1\1", text)


def _forms(text: str, changed: bool, normalize: bool) -> set[str]:
    """The message as the layers may see it before stand-ins are read."""
    if not changed:
        return {_capped(text)}
    dotted = text.replace("İ", "i̇")
    bare = dotted.translate(_ZERO_WIDTH)
    plain = (unicodedata.normalize("NFKC", bare) if normalize else bare).translate(_LOOKALIKES).replace("İ", "i̇")
    return {dotted, plain, *(_capped(t.translate(_ARABIC_FOLD)) for t in (dotted, plain))}


def suspicions(lex: L.Lexicon, normalize: bool = True):
    """Bits per text: a layer whose bit is not set finds nothing."""
    words = word_patterns(lex)
    groups = {**(words or {}), PERSONAL: ["|".join(_PERSONAL)], LINK: [_LINK]}
    always = WORDS if words is None else 0

    def bits(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), always, np.int32)
        for bit, patterns in groups.items():
            for pattern in patterns:
                out |= bit * pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int32)
        return out

    def screen(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        out = bits(texts)
        changed = pc.match_substring_regex(texts, _CHANGED).to_pylist()
        forms, owners = [], []
        for i in sorted({i for i, c in enumerate(changed) if c} | _with_runs(texts)):
            text = texts[i].as_py()
            for form in _forms(text, changed[i], normalize) - {text}:
                forms.append(form)
                owners.append(i)
        if forms:
            np.bitwise_or.at(out, owners, bits(pa.array(forms, pa.string())))
        return pa.array(out)

    return F.arrow_udf(screen, IntegerType())


def suspicion(text: Column, lex: L.Lexicon, normalize: bool = True) -> Column:
    return suspicions(lex, normalize)(text)


#: Terms up to which letters are compared before anything is folded.
MOST_FUZZY = 256


def _letter_masks() -> np.ndarray:
    """By code point, the letters it may be read as, one bit each (letters may share a bit); 0 where a fold may change it."""
    bit = lambda letters: sum({1 << ord(x) % 64 for x in letters})
    masks = np.zeros(0x250, np.uint64)
    for point in range(len(masks)):
        char = chr(point)
        if not re.search(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), _CHANGED), char):
            low = char.lower()
            read = {b for table in (T.LEET, T.LATIN_ARABIC_DIGITS) for a, b in zip(*table) if a in low}
            read |= {b for a, b in T.LATIN_ARABIC_PAIRS if set(low) & set(a)}
            masks[point] = bit({*low, *read})
    return masks


def near_letters(terms: list[str]):
    """A test over Arrow strings that holds at least where a word of some reading is within the fuzzy limit of a term.

    One edit takes at most one letter of a term away, so few of them may be missing."""
    masks = _letter_masks()
    wanted = [(np.uint64(sum({1 << ord(x) % 64 for x in t})), 1 if len(t) <= 6 else 2) for t in terms]

    def test(chunks: pa.Array) -> np.ndarray:
        sizes = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(terms) > MOST_FUZZY or not len(sizes) or not sizes.all():
            return np.ones(len(chunks), bool)
        points = np.frombuffer("".join(chunks.to_pylist()).encode("utf-32-le"), np.uint32)
        read = masks[np.minimum(points, 0x24F)]
        read[points > 0x24F] = 0
        starts = np.cumsum(sizes) - sizes
        held, out = np.bitwise_or.reduceat(read, starts), np.logical_or.reduceat(read == 0, starts)
        for mask, limit in wanted:
            out |= np.bitwise_count(mask & ~held) <= limit
        return out

    return test


def near_words(terms: list[str]):
    """The same for whole words: lengths, and letters that either side has alone, must fit the limit too."""
    wanted = [(len(t), np.uint64(sum({1 << ord(x) % 64 for x in t})), 1 if len(t) <= 6 else 2) for t in terms]

    def test(words: pa.Array) -> np.ndarray:
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(terms) > MOST_FUZZY or not len(sizes) or not sizes.all():
            return np.ones(len(words), bool)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        held = np.bitwise_or.reduceat(np.uint64(1) << (points % 64).astype(np.uint64), np.cumsum(sizes) - sizes)
        out = np.zeros(len(words), bool)
        for size, mask, limit in wanted:
            out |= (abs(sizes - size) <= limit) & (np.bitwise_count(mask & ~held) <= limit) & (np.bitwise_count(held & ~mask) <= limit)
        return out

    return test
