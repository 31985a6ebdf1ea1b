"""Undoing damage and spelling form: shared by the text operators.

``repair`` undoes text that was decoded with the wrong charset, ``fold`` brings a
word to a plain form (case, accents, ligatures, soft hyphens, look-alike letters).
"""

from __future__ import annotations

import html
import re
import unicodedata

#: Charsets that pages are decoded with by mistake, as fixed values.
WRONG_CHARSETS = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "koi8-r")
#: Characters without width that may stand inside words.
INVISIBLE = "­​‌‍‎‏⁠﻿᠎"
APOSTROPHES = "'’‘ʼ´`"
#: Letters that NFKD leaves whole, and Cyrillic and Greek letters that look like Latin ones, as fixed values.
PLAIN = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ß": "ss"}
LOOKALIKES = dict(zip("авсеԁһіјкмнорԛѕтухѵԝгαεικνορτυχ", "abcedhijkmhopqstyxvwraeiknoptux", strict=True))
#: Letters of Polish words as they look when read as Western, fixed values of both usual charsets.
POLISH = str.maketrans("³¹±¶¼¿œæêñ", "łąąśźżśćęń")

_POLISH_WORD = re.compile(r"(?:[^\W\d_]|[¿])*[³¹±¶¼](?:[^\W\d_]|[³¹±¶¼¿])*")
_POLISH_SIGN = re.compile("[³¹±¶¼]")
_HIGH = re.compile(r"[\x80-￿]+")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_TAG_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|sup|sub|font|mark|small|wbr|code|tt|s)(?:\s[^<>]*)?/?>", re.I)
_INLINE_MARKS = re.compile(r"\[/?(?:b|i|u|s|em|url|quote|color|size|font)(?:=[^\[\]\n]*)?\]|\\(?:emph|text\w{0,4}|underline)(?=\{)", re.I)
_TAG = re.compile(r"<[a-z/!][^<>]*>", re.I)
_BROKEN_LINE = re.compile(r"([^\W\d_])[-‐­¬][ \t]*\r?\n[ \t]*([^\W\d_])")
_MARKS = re.compile(r"[ÃÂÄÅÐÑâĂĹËÎÏ]|[À-ÿ£]{3}|[ТРСГ][Ѐ-џ\u0080-¿‘-›]")


def _as_bytes(run: str, charset: str) -> bytes | None:
    out = bytearray()
    for c in run:
        try:
            out += c.encode(charset)
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return None
            out.append(ord(c))
    return bytes(out)


def _undo(run: str) -> str:
    for charset in WRONG_CHARSETS:
        raw = _as_bytes(run, charset)
        if raw is None:
            continue
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    if len(run) >= 3 and all("À" <= c <= "ÿ" or c in "¨¸£³" for c in run):  # Cyrillic read as Western
        # of the two usual charsets the one that gives more small letters; in the other they'd be capitals
        return max((run.encode("latin-1").decode(c) for c in ("cp1251", "koi8-r")), key=lambda t: sum("а" <= x <= "ё" for x in t))
    return run


def _polish(m: re.Match) -> str:
    return m.group().translate(POLISH) if any(c.isascii() for c in m.group()) else m.group()


class Repairer:
    """``repair`` with a memory of the runs already seen; a null text stays null."""

    def __init__(self, most: int = 200_000):
        self._seen: dict[str, str] = {}
        self._most = most

    def _fix(self, m: re.Match) -> str:
        run = m.group()
        done = self._seen.get(run)
        if done is None:
            if len(self._seen) > self._most:
                self._seen.clear()
            done = self._seen[run] = _undo(run)
        return done

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if _MARKS.search(text):
            text = _HIGH.sub(self._fix, text)
        return _POLISH_WORD.sub(_polish, text) if _POLISH_SIGN.search(text) else text


def plain_layout(text: str) -> str:
    """Markup, character references and words broken over lines undone."""
    if "<" in text:
        text = _TAG.sub(" ", _TAG_INLINE.sub("", text))
    if "[" in text or "\\" in text:
        text = _INLINE_MARKS.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "­" in text or "‐" in text:
        text = _BROKEN_LINE.sub(r"\1\2", text)
    return text


def fold(word: str) -> str:
    """The plain form of one word: the same for any spelling form of it.

    Umlauts and their spellings with e fold alike (both to the bare vowel). Words in
    Cyrillic stay Cyrillic; single look-alikes among Latin letters become Latin.
    """
    w = _INVISIBLE.sub("", word).casefold()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
        w = "".join(PLAIN.get(c, c) for c in w)
        if any("a" <= c <= "z" for c in w):
            w = "".join(LOOKALIKES.get(c, c) for c in w)
        w = w.casefold()
    for c in APOSTROPHES:
        w = w.replace(c, "")
    if len(w) > 3:
        for c in ("ae", "oe", "ue"):
            w = w.replace(c, c[0])
    return w


def skeleton(word: str) -> str:
    """``word`` without any letter that a lost charset would have destroyed."""
    return fold("".join(c for c in unicodedata.normalize("NFC", word) if ord(c) < 128))
