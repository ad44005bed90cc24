"""Syllables by letter patterns with priorities, and sentences that abbreviations do not end.

A pattern is letters with one digit between two of them, and a point for a word's edge. Where its letters stand, it gives the
place of its digit that priority. The highest priority of a place counts: an odd one says that the letter behind
begins a syllable's core, an even one that it does not. So ``1a`` makes each a a core, ``e2a`` takes it back in "sea",
``cre3ate`` gives it again in "create".

All patterns together are one regular expression, by the letters on both sides of a place and from the highest priority down,
so a text's syllables are its matches: no word is looked at by itself, but for those without any match, which count one.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, present

VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
#: Letters with marks count as those without.
MARKED = ("àáâãäåèéêëìíîïòóôõöùúûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")

# Vowels that stand together and are two cores, and those of them that are not.
_TWO = """
y3a y3e y3i y3o y3u y4e. y4ed. y4es. .y5es.
i3a ci4a ti4a si4a gi4a .gi5ant i4age lli4a li4am li4ar ci5ate ti5ate ci5ati ti5ati
i3et i3ence i3ent ti4en ci4en .sci5en i3er. i3ers. i3est. i3eth .pi4er .ti4er nti4er hi4er di4er pri4est
i3o ti4o si4o gi4o ci4o xi4o hi4o ni4on ni4or li4on .li5on vi4or i3u i3i
cre3ate cre3ati cre3ato re3ali re3act the3at e3a. .te4a. .se4a. .pe4a. ple4a. fle4a. .where3as .line3ar nucle3ar ide3a are3a
e3ing e3inf de3it e3o pe4o ge4o ge5og ge5om ge5ol le4op je4o e3us e3um
co3ali .o3as po3e co3ex co3eff o3ing o3ic. co3inc co3op zo3ol
u3a qu4a gu4a rsu4a u3e qu4e gu4e u4e. u4ed. u4es. tu4es u3o qu4o u3u
lu3id ru3in su3ici u3ing tu3iti nu3it nu3in
a3ic. a3ive a3o
"""
# An e that is written and not spoken inside or at the end of words, and where it is spoken after all; a core without a vowel.
_SILENT = """
.b3e. .h3e. .m3e. .w3e. .sh3e. .th3e. cr3e. tr3e. isl4e. recip3e. trophe3e. mayb3e. caf3e. simil3e. karat3e.
.b3ed. .r3ed. .f3ed. .l3ed. .w3ed. .sh3ed. .sp3ed. .sl3ed. .fl3ed. .bl3ed. .br3ed. dr3ed. cr3ed. nak3ed. wick3ed.
.el3ement pl3ement tl3ement .c3ement cr3ement
.som2e .wher2e ther2efo .hom2e .lif2e .mak2e saf2ety nin2ety ev2ery ev2ening us2iness wedn2es
s3m. th3m. d3n. s3n.
"""


def _patterns() -> list[str]:
    """The table; whole classes of letters are written as rules."""
    rows = [f"1{v}" for v in VOWELS] + [f"{u}2{v}" for u in VOWELS for v in VOWELS]
    rows += [f".2y{v}" for v in "aeiou"]
    rows += [f"{c}2e." for c in CONSONANTS]
    rows += [f"{c}2es." for c in CONSONANTS if c not in "cghjsxz"]
    rows += [f"{c}2ed." for c in CONSONANTS if c not in "dt"]
    rows += [f"{c}2e{end}" for c in CONSONANTS for end in ("ly.", "ment", "ful", "less", "ness")]
    rows += [f"{c}l3e{end}" for c in "bcdfgkpstz" for end in (".", "s.", "d.")]
    return list(dict.fromkeys(rows + _TWO.split() + _SILENT.split()))


PATTERNS = _patterns()


def placed(pattern: str) -> tuple[str, int, str]:
    """What stands before the place, its priority, and what stands behind."""
    before, digit, behind = re.fullmatch(r"([a-z.]*)([1-9])([a-z.]+)", pattern).groups()
    return before, int(digit), behind


def _any_mark(letters: str) -> str:
    """Each letter, or one of those that stand for it with a mark."""
    return "".join(_ALIKE.get(c, c) for c in letters)


#: Classes of a letter and its marked ones, and of all letters.
_ALIKE = {c: f"[{c}{''.join(m for m, plain in zip(*MARKED) if plain == c)}]" for c in set(MARKED[1])}
_LETTER, _VOWEL = f"[a-z{MARKED[0]}]", "".join(_ALIKE[v] for v in VOWELS).replace("][", "")


def _places(patterns: list[tuple[str, str]]) -> str:
    """A regular expression of the places between any ``before`` and ``behind``; those that differ in the one letter before become one class."""
    groups: dict[str, list[str]] = defaultdict(list)
    for before, behind in patterns:
        groups[behind].append(before)
    out = []
    for behind, befores in groups.items():
        ahead = _any_mark(behind.rstrip(".")) + (f"(?!{_LETTER})" if behind.endswith(".") else "")
        single = [b for b in befores if len(b) == 1 and b != "."]
        lefts = [f"(?<={''.join(map(_any_mark, single)) if len(single) == 1 else '[' + ''.join(map(_any_mark, single)).replace('[', '').replace(']', '') + ']'})"] if single else []
        for b in befores:
            if b not in single:
                edge, letters = f"(?<!{_LETTER})" if b.startswith(".") else "", _any_mark(b.lstrip("."))
                lefts.append(f"(?<={edge}{letters})" if letters else edge)
        left = lefts[0] if len(lefts) == 1 else f"(?:{'|'.join(lefts)})"
        out.append(f"(?={ahead}){left}")
    return "|".join(out)


def _decided(levels: dict[int, list[tuple[str, str]]], base: int) -> str:
    """Whether the highest priority is odd, where ``base`` holds everywhere."""
    inner = "" if base % 2 else "(?!)"
    for priority in sorted(p for p in levels if p > base):
        some = _places(levels[priority])
        if priority % 2:
            inner = "" if not inner else f"(?:{some})" if inner == "(?!)" else f"(?:{some}|{inner})"
        else:
            inner = f"(?!{some}){inner}"
    return inner


def expression(patterns: list[str]) -> str:
    """A regular expression that matches, without a character, at each place of odd priority in lower-case text.

    It goes by the letter behind a place, and by whether a vowel stands before: there the priorities that always hold
    (those of ``1a`` and ``e2a``) need no test, so most places are decided by two letters.
    """
    table: dict[str, dict[bool, dict[int, list[tuple[str, str]]]]] = defaultdict(lambda: {True: defaultdict(list), False: defaultdict(list)})
    for pattern in patterns:
        before, priority, behind = placed(pattern)
        for after_vowel in (True, False):
            if not before or (before[-1] in VOWELS) == after_vowel:
                table[behind[0]][after_vowel][priority].append((before, behind))
    letters = []
    for letter in sorted(table, key=lambda c: "eaioutmny".find(c)):
        inside, outside = (_decided(table[letter][k], (2 if k else 1) if letter in VOWELS else 0) for k in (True, False))
        here = _any_mark(letter)
        letters.append(f"(?={here})(?:(?<=[{_VOWEL.strip('[]')}]){inside}|(?<![{_VOWEL.strip('[]')}]){outside})")
    first = "".join(_any_mark(c) for c in sorted(table)).replace("[", "").replace("]", "")
    return f"(?=[{first}])(?:{'|'.join(letters)})"


CORES = expression(PATTERNS)
#: Characters of words, and those that are no a, i, o or u: where one of these is, there is a core.
_WITHIN = "[^" + SPACE[1:]
_CLOSED = "[^" + "".join(_any_mark(c) for c in "aiou").replace("[", "").replace("]", "") + SPACE[1:]
#: The beginnings of words without any core; one range of characters is the quickest to look at.
CORELESS = f"(?<![!-~])(?<!{_WITHIN})(?={_CLOSED}++(?!{_WITHIN}))(?!{_WITHIN}*?{CORES})"


def syllables(text: Column) -> Column:
    """Of a text: one a word at least."""
    # a place is never both
    return F.regexp_count(F.lower(text), F.lit(f"{CORES}|{CORELESS}"))


# Abbreviations (without their last point) that stand inside sentences; single letters count as such too.
ABBREVIATIONS = """
mr mrs ms dr prof sr jr st mt rev gen sgt capt lt gov sen pres
jan feb apr jun jul aug sept oct nov
vs etc al cf eg ie approx dept est inc ltd co corp vol pp eds ave blvd rd
""".split()
MARKS, CLOSERS = ".!?…", ")\\]}\"'”’»"
_SINGLE = rf"(?<![{MARKS}])(?<!(?<!\p{{L}})(?i:{'|'.join(ABBREVIATIONS)}|\p{{L}}))\.(?![{MARKS}])"
END = rf"(?=[{MARKS}])(?:{_SINGLE}|[{MARKS}]{{2,}}|(?<![{MARKS}])[!?…](?![{MARKS}]))[{CLOSERS}]*"


def sentences(text: Column | str) -> Column:
    """Words that end in ``.!?…`` (closing marks may follow), but for single points after abbreviations and ends before a small letter; what follows the last end counts as one more, and there is one at least."""
    text = present(text)
    last = text.rlike(rf"{END}{SPACE}*\z")
    return F.regexp_count(text, F.lit(rf"{END}(?={SPACE}+(?!{SPACE}|\p{{Ll}})|{SPACE}*\z)")) + F.when(last, 0).otherwise(1)
