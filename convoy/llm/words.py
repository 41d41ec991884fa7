"""Words of marked-up text, with and without their places."""

from __future__ import annotations

import html
import re
import unicodedata

#: Markup tags count as blanks (fixed patterns): <...> that opens like a tag, [tag], [/tag], [tag=...].
TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|<!--.*?-->|\[/?(?:[a-zA-Z][a-zA-Z0-9]*|\*)(?:=[^\[\]]*)?\]", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});?")
#: A run of letters or digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in order, in lower case: markup tags are blanks, entities the characters they stand for."""
    if "<" in text or "[" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The same words with where each begins and ends in ``text`` as written."""
    blanked = TAG.sub(lambda m: " " * len(m[0]), text)
    chars: list[str] = []
    begin: list[int] = []
    end: list[int] = []

    def add(s: str, a: int, b: int | None = None) -> None:
        for i, c in enumerate(s):
            chars.append(c)
            begin.append(a if b is not None else a + i)
            end.append(b if b is not None else a + i + 1)

    at = 0
    for m in ENTITY.finditer(blanked):
        add(blanked[at : m.start()], at)
        add(html.unescape(m[0]), m.start(), m.end())
        at = m.end()
    add(blanked[at:], at)
    plain = "".join(chars)
    if plain.isascii():
        return [(m[0].lower(), begin[m.start()], end[m.end() - 1]) for m in WORD.finditer(plain)]
    # Compose each letter with the marks after it, and lower it, one at a time, so that places stay known.
    out, a, b = [], [], []
    i = 0
    while i < len(plain):
        j = i + 1
        while j < len(plain) and unicodedata.combining(plain[j]):
            j += 1
        for c in unicodedata.normalize("NFC", plain[i:j]).lower():
            out.append(c)
            a.append(begin[i])
            b.append(end[j - 1])
        i = j
    return [(m[0], a[m.start()], b[m.end() - 1]) for m in WORD.finditer("".join(out))]
