"""Problem 3: sentences across languages and scripts, by cascading tables of ordered rules.

A rule is a pair of regular expressions for what stands before and after a position, and says break
or no break. At every candidate position the rules of the text's language are tried in order and the
first that matches decides. Tables cascade: a language's own rules come first, then those of its
script family, then the rules for all.

Candidates are the places after end marks (with the quotes and brackets that close there), after
blanks and line breaks for Thai, and blank lines. Units are trimmed of blanks; offsets are code
points, end exclusive.

Defined results: a null text gives no rows; an empty or blank text gives none either; repeated rows
are split each; a null row id is kept; an empty table gives an empty result. Whole texts are
processed whatever their length, in one pass per text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import SAME_LENGTH

# Characters that show nothing; they may stand anywhere inside words and blanks.
_IGN = r"[­​-‍⁠﻿]*"
_SP = r"(?:[^\S\n\r]|[​⁠﻿­])"
_CLOSE_MARKS = r"\"'”’»›」』）)\]】〉》"
_OPEN = r"[\"'“‘„«‹「『（(\[【〈《¿¡]"
_END = r"[.!?…。！？．｡।॥؟۔]"


def _letters(word: str) -> str:
    """A pattern for a word with unseen characters allowed between its letters."""
    return _IGN.join(regex.escape(c) for c in word)


def _abbr(*words: str) -> str:
    return r"(?<![\p{L}\p{N}])(?i:" + "|".join(_letters(w) for w in words) + ")" + _IGN + r"\." + _IGN


# Abbreviations by language, grouped by what may follow them.
#: never end a sentence: something they belong to follows
_BEFORE_NAME = {
    "en": ["Dr", "Mr", "Mrs", "Ms", "Prof", "Rev", "St", "Gen", "Col", "Capt", "Lt", "Sgt", "Hon", "Gov", "Sen", "Rep", "Mt", "Messrs", "vs", "cf", "e.g", "i.e", "viz", "Fig", "Figs", "Eq", "Eqs", "Ch", "Sec", "Vol", "pp", "approx", "ca", "al"],
    "de": ["Dr", "Prof", "Hr", "Fr", "Frl", "St", "z. B", "z.B", "d. h", "d.h", "u. a", "u.a", "bzw", "ca", "vgl", "Nr", "Abb", "Bd", "S", "ggf", "evtl", "inkl", "sog", "z", "d", "i. d. R"],
    "fr": ["M", "MM", "Dr", "Pr", "Me", "Mgr", "St", "Ste", "cf", "p", "pp", "fig", "vol", "chap", "art", "env", "av", "apr", "p. ex", "c.-à-d"],
    "es": ["Sr", "Sra", "Srta", "Dr", "Dra", "D", "Dña", "Ud", "Uds", "Prof", "p. ej", "p.ej", "p", "pág", "págs", "núm", "fig", "cap", "vol", "aprox", "EE. UU"],
    "ru": ["т. е", "т.е", "т", "стр", "с", "г", "гг", "др", "проф", "акад", "им", "ул", "рис", "табл", "см", "ср", "напр", "св", "д"],
    "ar": ["د", "أ", "م", "ص", "ج"],
    "hi": ["डॉ", "श्री", "पं", "प्रो", "कु", "सं", "पृ"],
}
#: end a sentence only if what follows can begin one
_MAYBE_LAST = {
    "en": ["etc", "Jr", "Sr", "Co", "Inc", "Ltd", "Corp", "Bros", "a.m", "p.m", "U.K", "U.S", "U.N", "D.C", "B.C", "A.D", "Ph.D", "M.D"],
    "de": ["usw", "etc", "u. Ä", "Co", "jr"],
    "fr": ["etc", "Cie"],
    "es": ["etc", "Cía", "S. A"],
    "ru": ["др", "пр", "т. д", "т. п", "г", "гг", "руб", "коп", "тыс", "н. э"],
    "ar": [],
    "hi": [],
}
#: no break before a number
_BEFORE_NUMBER = {
    "en": ["No", "Nos", "p", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "Art", "Op"],
    "de": ["Nr", "S", "Art", "Jan", "Feb", "Aug", "Sept", "Okt", "Nov", "Dez"],
    "fr": ["n", "no", "janv", "févr", "avr", "juil", "sept", "oct", "nov", "déc"],
    "es": ["n", "No", "ene", "feb", "sept", "oct", "nov", "dic"],
    "ru": ["п", "№", "гл"],
    "ar": [],
    "hi": [],
}
#: months, after which a German day number with its point stands
_GERMAN_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jh|Jahrhundert"
#: verbs that join a quotation to its speaker
_SAYING = {
    "en": "said|says|asked|asks|cried|wrote|replied|answered|added|joked|shouted|whispered|called|muttered|told|explained|insisted|exclaimed|thought|wondered|murmured|remarked|observed",
    "de": "sagte|fragte|rief|antwortete|schrieb|meinte|flüsterte",
    "fr": "dit|demanda|répondit|cria|écrivit|ajouta|murmura",
    "es": "dijo|preguntó|respondió|gritó|escribió|añadió|contestó",
    "ru": "сказал|сказала|спросил|спросила|ответил|ответила|крикнул|крикнула|написал|написала|добавил|добавила",
}

BREAK, KEEP = True, False


def _close(lang: str) -> str:
    """Closing quotes and brackets; German closes with the marks that open a quotation elsewhere."""
    return f"[{_CLOSE_MARKS}{'“‘«‹' if lang == 'de' else ''}]"


Rule = tuple[bool, str, str]


def _rules(lang: str) -> list[Rule]:
    """The cascade for one language: (break?, before, after), first match decides."""
    close = _close(lang)
    own: list[Rule] = []
    if lang in ("zh", "ja"):
        own += [
            # a quotation followed by its reporting clause, or by the particle that builds it in
            (KEEP, rf"{_END}{close}+", r"\s*(?:と|って|という|、|，|,)"),
            (KEEP, rf"{_END}[”’」』]+", r"[^。！？\n“「『]*?(?:说|問|问|道|喊|叫|答|写道|说道|问道|言った|尋ねた)[。！？]"),
            (KEEP, r"[0-9０-９][.．]", r"[0-9０-９]"),
            # the sentence mark before a closing quote or bracket waits for it
            (KEEP, _END, rf"{_IGN}(?:{_END}|[”’」』）)\]】》〉])"),
            (BREAK, rf"[。！？!?｡…][”’」』）)\]】》〉\"']*{_IGN}", r"(?s:.)"),
            (KEEP, r"\.", r"(?s:.)"),
        ]
    if lang == "th":
        own += [
            (KEEP, rf"[0-9๐-๙]{_SP}*", rf"[0-9๐-๙]"),
            (BREAK, r"\s", r"\S"),
            (KEEP, r"(?s:.)", r"(?s:.)"),
        ]
    for table, after in ((_BEFORE_NUMBER, rf"{_SP}*{_IGN}[\p{{Nd}}]"), (_BEFORE_NAME, r"\s*\S")):
        words = table.get(lang) or []
        if words:
            own.append((KEEP, _abbr(*words), after))
    if _MAYBE_LAST.get(lang):
        words = _abbr(*_MAYBE_LAST[lang])
        own += [
            (KEEP, words, rf"\s*{_IGN}[,;:)\]\p{{Ll}}\p{{Nd}}—–-]"),
            # a shortened name before more of the same name or phrase
            (KEEP, _abbr("U.K", "U.S", "U.N", "D.C"), rf"\s*{_IGN}(?:Government|Parliament|Army)\b"),
        ]
    if lang == "de":
        own += [
            (KEEP, r"(?<![\p{L}\p{N}])\p{Nd}{1,2}\.", rf"{_SP}+(?:{_GERMAN_MONTHS})\b"),
        ]
    if lang in _SAYING:
        # the clause that reports a question or a cry; but a verb with its own quotation begins anew
        plain = rf"(?!{_IGN},?\s*{_OPEN})"
        own.append((KEEP, rf"[!?…]{_IGN}{close}+{_IGN}", rf"\s+{_IGN}(?:\p{{Lu}}[\p{{L}}\p{{Cf}}'’-]*{_SP}+){{1,3}}(?:{_SAYING[lang]})\b{plain}"))
        own.append((KEEP, rf"[!?…]{_IGN}{close}+{_IGN}", rf"\s+{_IGN}(?i:{_SAYING[lang]})\b"))
    if lang == "en":
        # in capitals throughout, case tells nothing: names of firms and people go on, as does what an article opens
        own += [
            (KEEP, rf"\p{{Lu}}{_IGN}\s&\s{_IGN}C{_IGN}O{_IGN}\.", r"\s+\p{Lu}{2,}"),
            (KEEP, rf"\p{{Lu}}{_IGN}\sJ{_IGN}R{_IGN}\.", r"\s+\p{Lu}{2,}"),
            (KEEP, rf"THE\s{_IGN}(?:\p{{Lu}}{_IGN}\.{_IGN}){{2,}}", r"\s+\p{Lu}{2,}"),
            (KEEP, rf"E{_IGN}T{_IGN}C{_IGN}\.", r"\s+(?:TO|OF|FOR|AND|OR|IN|ON|AT|WITH|AS|FROM|BY)\b"),
        ]
    if lang in ("en", "de", "fr", "es", "ru", ""):
        own += [
            # initials: a single capital before a name
            (KEEP, rf"(?:^|[\s(“\"‘'«„]){_IGN}\p{{Lu}}{_IGN}\.{_IGN}", rf"\s*{_IGN}\p{{Lu}}[\p{{L}}\p{{Cf}}]*(?:\.|\s|')"),
            (KEEP, rf"(?:(?<![\p{{L}}\p{{N}}])\p{{Lu}}\.){{2,}}", rf"\s*\p{{Ll}}"),
        ]
    common: list[Rule] = [
        # inside numbers, names of files and versions
        (KEEP, rf"{_END}", rf"{_IGN}[\p{{L}}\p{{N}}_]" if lang not in ("zh", "ja", "hi", "ar") else rf"{_IGN}[\p{{N}}_]"),
        # a run of marks, and closing marks, belong together
        (KEEP, rf"{_END}{_IGN}", rf"{_IGN}{_END}"),
        (KEEP, rf"{_END}{_IGN}", rf"{_IGN}[”’»›」』）)\]】]"),
        (KEEP, rf"{_END}{_IGN}", rf"{_IGN}[\"'](?!\p{{L}})"),
        (KEEP, rf"{_END}{close}+{_IGN}", rf"{_SP}+{_IGN}{_END}"),
        # French puts a blank between the last mark and the closing quote
        (KEEP, rf"{_END}{_IGN}", rf"{_SP}+[»!?]"),
        # quoted or bracketed end marks in mid sentence: the sentence goes on in lower case or after a comma or dash
        (KEEP, rf"{_END}{close}*{_IGN}", rf"\s*{_IGN}[,;:،؛、]"),
        (KEEP, rf"{_END}(?:{_SP}*{close})+{_IGN}", rf"{_SP}*{_IGN}[—–-]"),
        (KEEP, rf"{_END}(?:{_SP}*{close})*{_IGN}", rf"\s+{_IGN}[\p{{Ll}}]"),
        (BREAK, rf"{_END}(?:{_SP}*{close})*{_IGN}", r"\s"),
        (BREAK, r"[!?؟।॥۔。！？](?:" + close + r")*", r"(?s:.)" if lang in ("hi", "ar") else r"[\p{Lo}]"),
    ]
    return own + common


def _candidate(lang: str) -> str:
    if lang == "th":
        return r"\s+(?=\S)"
    return rf"(?:{_END}{_IGN})+(?:{_close(lang)}{_IGN})*(?:{_SP}+[»](?=\s|$|[,.—–-]))?"


_BLANK_LINE = r"(?:\r\n|\n|\r)(?:[^\S\n\r]|[​⁠﻿­])*(?:\r\n|\n|\r)\s*"


@lru_cache(maxsize=64)
def compiled(lang: str) -> tuple:
    """Candidate pattern; the ordered rules as one pattern anchored at a position, whose group tells which matched first; what each says."""
    rules = _rules(lang)
    cascade = "|".join(f"(?<={before})(?={after})()" for _, before, after in rules)
    return regex.compile(_candidate(lang)), regex.compile(cascade), [False, *(brk for brk, _, _ in rules)]


_BLANKS = regex.compile(_BLANK_LINE)
_SCRIPTS = [("th", r"\p{Thai}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ru", r"\p{Cyrillic}")]
_SCRIPTS = [(k, regex.compile(v)) for k, v in _SCRIPTS]
_OTHER_SCRIPT = regex.compile(r"[\p{Thai}\p{Devanagari}\p{Arabic}\p{Hiragana}\p{Katakana}\p{Han}\p{Cyrillic}]")
_LATIN = regex.compile(r"\p{Latin}")
# A few of the commonest words of each language in Latin script
_COMMON = {
    "en": set("the and of to in a is was were that it they with for on from her his i we she he".split()),
    "de": set("der die das und den dem ein eine nicht mit von zu im am auf ist war hinter ohne".split()),
    "fr": set("le la les un une et des du de dans sur est était pour avec par au aux sous derrière".split()),
    "es": set("el la los las un una y de del en con por para es era junto después al bajo sin".split()),
}
COMMON_WORDS = frozenset().union(*_COMMON.values())
# Letters and marks that one of them uses and the others hardly do
_MARKS = {"de": regex.compile(r"[äöüßÄÖÜ„]"), "fr": regex.compile(r"[àâçèêëîôœùûÀÉÊ]|\b[LDldcs]['’](?=\p{L})"), "es": regex.compile(r"[áíóúñ¿¡]")}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{Cf}]*")
_ASCII_WORD = re.compile(r"[a-z]+")


def tag(lang: str | None) -> str:
    """The two letters of a language tag, whatever its case, region or blanks."""
    return (lang or "").strip().lower().replace("_", "-").split("-")[0]


def language(text: str, given: str | None) -> str:
    """The language whose rules hold: by script first, in Latin script by common words, then as given."""
    # a share of each script over the whole text; look-alike letters inside words do not outweigh the rest
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        latin = len(_LATIN.findall(text))
        best, most = "", latin * 0.5
        for k, p in _SCRIPTS:
            n = len(p.findall(text))
            if k == "zh" and best == "ja":
                continue
            if k == "ja" and n and n * 20 > len(text):
                return "ja"
            if n > most:
                best, most = k, n
        if best:
            return best
    words = (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())
    times = Counter(words)
    votes = {k: sum(times[w] for w in s) for k, s in _COMMON.items()}
    given = tag(given)
    for k, p in _MARKS.items():
        votes[k] += len(p.findall(text))
    top = max(votes.values())
    if given in votes and votes[given] >= top * 0.5:
        return given
    if top:
        return max(votes, key=lambda k: votes[k])
    return given if given in _COMMON else "en"


def boundaries(text: str, lang: str) -> list[int]:
    """Positions at which a sentence ends, in order."""
    cand, cascade, breaks = compiled(lang)
    if lang in _COMMON and not text.isascii():
        text = text.translate(SAME_LENGTH)  # look-alike letters inside abbreviations; offsets stay
    cuts = []
    for m in cand.finditer(text):
        at = m.end()
        if at >= len(text):
            continue
        first = cascade.match(text, at)
        if first and breaks[first.lastindex]:
            cuts.append(at)
    cuts.extend(m.start() for m in _BLANKS.finditer(text))
    cuts.append(len(text))
    return sorted(set(cuts))


def split(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text."""
    if not text or text.isspace():
        return []
    out, start = [], 0
    for end in boundaries(text, language(text, lang)):
        piece = text[start:end]
        a = start + len(piece) - len(piece.lstrip())
        b = start + len(piece.rstrip())
        if b > a:
            out.append((a, b))
        start = end
    return out


def sentences(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """key, start_off, end_off of every sentence; one narrow map over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, ends = [], [], []
            for k, t, g in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for x, y in split(t, g):
                    keys.append(k)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=b.column(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_off", "end_off"])

    src = df.select(F.col(key), F.col(text).cast("string").alias("text_"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang_"))
    return src.filter("text_ IS NOT NULL").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start_off int, end_off int")
