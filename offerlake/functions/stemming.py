"""French stemming of a vocabulary by the published Snowball rules.

Stemming is a function of the word alone, so it runs once for every distinct word (an Arrow batch at a time) and
the stems are joined back; texts are never stemmed word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.session import ship_by_value

ship_by_value(__name__)

# The letters and endings of the published rules. Capital letters stand for vowels that act as
# consonants, H for the dot of a diaeresis.
VOWELS = "aeiouyâàëéêèïîôûù"
R2_DELETED = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
ATION = "atrice ateur ation atrices ateurs ations".split()
I_VERB = ("îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is "
          "issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it").split()
E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
RV_PREFIXES = ("par", "col", "tap")


def _either(endings: list[str]) -> str:
    return "(?:" + "|".join(sorted(endings, key=len, reverse=True)) + ")$"


_V = f"[{VOWELS}]"
_C = f"[^{VOWELS}]"
_SUFFIXES = sorted(R2_DELETED + ATION + ("logie logies usion ution usions utions ence ences ement ements ité ités if ive "
                   "ifs ives eaux aux euse euses issement issements amment emment ment ments").split(), key=len, reverse=True)
_AFTER_CONSONANT = re.compile(f"{_V}{_C}")
_I_VERB, _E_OR_A = re.compile(_either(I_VERB)), re.compile(_either(["ions", *E_VERB, *A_VERB]))


class _Word:
    """A word under the rules: its letters and the starts of the regions RV, R1 and R2."""

    def __init__(self, word: str):
        w = re.sub("qu", "qU", word.replace("ë", "He").replace("ï", "Hi"))
        w = re.sub(f"(?<={_V})([ui])(?={_V})", lambda m: m[1].upper(), w)
        w = re.sub(f"(?<={_V})y|y(?={_V})", "Y", w)
        self.w = w
        if w.startswith(RV_PREFIXES) or re.match(_V * 2, w):
            self.rv = min(3, len(w))
        else:
            first = re.search(_V, w[1:])
            self.rv = first.end() + 1 if first else len(w)
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)

    def _after(self, start: int) -> int:
        m = _AFTER_CONSONANT.search(self.w, start)
        return m.end() if m else len(self.w)

    def cut(self, ending: str, region: int, by: str = "") -> bool:
        """Replace ``ending`` where the word has it inside the region that starts at ``region``."""
        at = len(self.w) - len(ending)
        if not self.w.endswith(ending) or at < region:
            return False
        self.w = self.w[:at] + by
        return True


def _standard(x: _Word) -> bool:
    """Noun, adjective and adverb endings; True when the verb endings need not be tried."""
    s = next((e for e in _SUFFIXES if x.w.endswith(e)), None)
    if s is None:
        return False
    if s in R2_DELETED:
        return x.cut(s, x.r2)
    if s in ATION:
        if not x.cut(s, x.r2):
            return False
        x.cut("ic", x.r2) or x.cut("ic", 0, "iqU")
        return True
    if s.startswith("logie"):
        return x.cut(s, x.r2, "log")
    if s.startswith(("usion", "ution")):
        return x.cut(s, x.r2, "u")
    if s.startswith("ence"):
        return x.cut(s, x.r2, "ent")
    if s in ("ement", "ements"):
        if not x.cut(s, x.rv):
            return False
        if x.w.endswith("iv"):
            if x.cut("iv", x.r2):
                x.cut("at", x.r2)
        elif x.w.endswith("eus"):
            x.cut("eus", x.r2) or x.cut("eus", x.r1, "eux")
        elif x.w.endswith(("abl", "iqU")):
            x.cut(x.w[-3:], x.r2)
        elif x.w.endswith(("ièr", "Ièr")):
            x.cut(x.w[-3:], x.rv, "i")
        return True
    if s.startswith("ité"):
        if not x.cut(s, x.r2):
            return False
        if x.w.endswith("abil"):
            x.cut("abil", x.r2) or x.cut("abil", 0, "abl")
        elif x.w.endswith("ic"):
            x.cut("ic", x.r2) or x.cut("ic", 0, "iqU")
        else:
            x.cut("iv", x.r2)
        return True
    if s in ("if", "ive", "ifs", "ives"):
        if not x.cut(s, x.r2):
            return False
        if x.cut("at", x.r2):
            x.cut("ic", x.r2) or x.cut("ic", 0, "iqU")
        return True
    if s == "eaux":
        return x.cut(s, 0, "eau")
    if s == "aux":
        return x.cut(s, x.r1, "al")
    if s.startswith("euse"):
        return x.cut(s, x.r2) or x.cut(s, x.r1, "eux")
    if s.startswith("issement"):
        before = x.w[: -len(s)]
        return bool(before) and before[-1] not in VOWELS and x.cut(s, x.r1)
    if s in ("amment", "emment"):
        x.cut(s, x.rv, s[0] + "nt")
        return False
    before = len(x.w) - len(s) - 1  # ment, ments: behind a vowel that lies in RV
    if before >= x.rv and x.w[before] in VOWELS:
        x.w = x.w[: before + 1]
    return False


def _i_verb(x: _Word) -> bool:
    m = _I_VERB.search(x.w, x.rv)
    if not m or m.start() - 1 < x.rv or x.w[m.start() - 1] in VOWELS + "H":
        return False
    x.w = x.w[: m.start()]
    return True


def _verb(x: _Word) -> bool:
    m = _E_OR_A.search(x.w, x.rv)
    if not m:
        return False
    if m[0] == "ions":
        return x.cut("ions", x.r2)
    x.w = x.w[: m.start()]
    if m[0] in A_VERB:
        x.cut("e", x.rv)
    return True


def _residual(x: _Word) -> None:
    if len(x.w) > 1 and x.w[-1] == "s" and (x.w[-3:-1] == "Hi" or x.w[-2] not in "aiouès"):
        x.w = x.w[:-1]
    m = re.compile("(?:ion|i[eè]re?|I[eè]re?|e)$").search(x.w, x.rv)
    if m is None:
        return
    if m[0] == "ion":
        before = len(x.w) - 4
        if before >= x.rv and x.w[before] in "st":
            x.cut("ion", x.r2)
    elif m[0] in ("ier", "ière", "Ier", "Ière"):
        x.w = x.w[: m.start()] + "i"
    else:
        x.cut("e", x.rv)


def french_stem(word: str) -> str:
    """Stem of one lower-cased word; a word without a letter of the rules stays as it is."""
    x = _Word(word)
    if _standard(x) or _i_verb(x) or _verb(x):
        x.w = x.w[:-1] + {"Y": "i", "ç": "c"}[x.w[-1]] if x.w.endswith(("Y", "ç")) else x.w
    else:
        _residual(x)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    w = re.sub(f"[éè]({_C}+)$", r"e\1", x.w)
    w = w.replace("He", "ë").replace("Hi", "ï").replace("H", "")
    return w.translate(str.maketrans("IUY", "iuy"))


def stem_vocabulary(words: DataFrame, col: str = "lexeme") -> DataFrame:
    """``(lexeme, stem)``: one row for every distinct non-null word."""
    distinct = words.select(F.col(col).alias("lexeme")).where("lexeme is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(stem=[french_stem(w) for w in pdf["lexeme"]])

    return distinct.mapInPandas(run, "lexeme string, stem string")
