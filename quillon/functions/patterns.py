"""Rules and patterns. The patterns are fixed values: a rule's hits are exactly their matches.

They are written once, for two engines: ``\\w`` and ``\\s`` stand for the classes below and are
put in by ``java`` and ``re2``. Patterns must match nothing empty."""

from __future__ import annotations

from dataclasses import dataclass

#: white space, as code points; written out so that every engine means the same
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = r"[A-Za-z][A-Za-z'\x{2019}-]*"
BLANK_LINE = rf"\n{WS}*\n"


def java(pattern: str) -> str:
    """For java.util.regex."""
    return pattern.replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"\w", WORD_CHAR).replace(r"\s", WS)


re2 = java  # the same source holds for RE2; callers keep lookarounds out of it


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str  # H, M or L
    title: str
    why: str
    fix: str
    patterns: tuple[str, ...] = ()


RULES: dict[str, Rule] = {
    r.id: r
    for r in (
        Rule("vocab", "H", "overused word", "A word that became frequent in generated text.", "Use the plainest word that says the same."),
        Rule("emdash", "M", "long dash", "Long dashes stand where other marks serve.", "Use a comma, a full stop or brackets.", (r"[\x{2014}\x{2013}]", r"(?<=\s)-{2,}(?=\s)")),
        Rule(
            "negation",
            "H",
            "denial before claim",
            "A claim is set up by denying another.",
            "Say the positive claim alone.",
            (
                r"\b(?:is|it'?s|this is|that'?s)\s+not\s+(?:just|only|merely|simply)\b",
                r"\b(?:isn'?t|aren'?t|wasn'?t|doesn'?t|don'?t)\s+(?:just|only|merely|simply)\b",
                r"\bnot\s+(?:just|only|merely)\s+\w+[^.]{0,40}\bbut\b",
                r"\bnot\s+(?:about|because of)\s+\w+[^.]{0,40},\s*(?:it'?s|but)\b",
                r"\bthis (?:is|was) not an?\b",
                r"\bit'?s not (?:a|an|the)\b[^.]{0,40}\bit'?s (?:a|an|the)\b",
                r"\bnot\s+[^.]{0,60}\.\s+Rather,\s",
                r"\b(?:isn'?t|aren'?t|wasn'?t|weren'?t)\s+(?:a|an|the)\b[^.]{0,50},\s*(?:it'?s|they'?re|that'?s|it is)\b",
            ),
        ),
        Rule(
            "litotes",
            "M",
            "claim by denial",
            "Something is asserted by denying its opposite.",
            "Assert it.",
            (
                r"\bnot\s+an?\s+(?!single\b)\w+\s+one\b",
                r"\bnot\s+un(?:common|usual|important|reasonable|likely|familiar|helpful|pleasant|related|true|aware|welcome|interesting|impressive|fair|kind|clear|remarkable|surprising)\b",
                r"\bnot\s+without\s+\w+",
            ),
        ),
        Rule(
            "copula",
            "M",
            "avoided copula",
            "A longer verb stands where 'is' would do.",
            "Use a form of 'to be'.",
            (r"\b(?:serves|stands|functions|acts)\s+as\s+(?:a|an|the)\b", r"\b(?:marks|represents|constitutes|embodies|exemplifies)\s+(?:a|an|the)\b", r"\bemerged\s+as\s+(?:a|an|the)\b"),
        ),
        Rule("assoc", "M", "vague tie", "A relation is hinted at and not named.", "Name the relation.", (r"\b(?:associated|connected|linked)\s+(?:with|to)\b", r"\bin connection with\b")),
        Rule("fragments", "M", "stack of fragments", "Several very short sentences in a row.", "Join some of them."),
        Rule(
            "transitions",
            "M",
            "stock connective",
            "A connective that only looks orderly.",
            "Drop it, or rewrite if the link is then unclear.",
            (
                r"\bmoreover\b",
                r"\bfurthermore\b",
                r"\bconsequently\b",
                r"\bin addition,",
                r"\badditionally\b",
                r"\bnotably,",
                r"\bimportantly,",
                r"\bindeed,",
                r"\bthus,",
                r"\bhence,",
                r"\bit is (?:important|worth) (?:to note|noting)\b",
                r"\bit'?s worth noting\b",
                r"\bin today'?s\b",
                r"\bin conclusion\b",
                r"\bultimately,",
                r"\bin essence\b",
                r"\bat its core\b",
            ),
        ),
        Rule(
            "narrator",
            "H",
            "announced move",
            "The text says what it is about to do.",
            "Do it without saying so.",
            (
                r"\bhere'?s the thing\b",
                r"\bhere (?:is|are) the (?:test|point|part|result|kicker)\b",
                r"\bthe point is\b",
                r"\bwhat'?s (?:remarkable|striking|fascinating|interesting) (?:is|here)\b",
                r"\bthat'?s the (?:paradox|puzzle|point|kicker|twist|rub)\b",
                r"\band (?:it'?s|that'?s) my favou?rite\b",
                r"\blet me be clear\b",
                r"\bi want to be clear\b",
                r"\bto be clear,",
                r"\bmake no mistake\b",
                r"\bthe (?:real|bigger|deeper) question is\b",
                r"\bwhich (?:brings|takes) (?:us|me) (?:to|back)\b",
                r"\bbut here'?s\b",
                r"\bthe bottom line\b",
            ),
        ),
        Rule(
            "participial",
            "M",
            "participle tail",
            "A participle clause is hung on a finished sentence.",
            "Cut it or make it a sentence.",
            (
                r",\s+(?:highlighting|underscoring|showcasing|demonstrating|reflecting|ensuring|emphasizing|illustrating|revealing|marking|cementing|paving|signaling|signalling|solidifying)\b",
            ),
        ),
        Rule("colon", "L", "colon before the point", "A colon holds back the point.", "Work the point into the sentence.", (r"[a-z]{3,}:[ \t]+[A-Za-z][^.\n]{0,70}(?<!\d)\.",)),
        Rule("question", "M", "question as opening", "A paragraph opens with a question.", "Open with the statement."),
        Rule(
            "recap",
            "M",
            "said again",
            "What was just said is said again.",
            "Cut it.",
            (r"\bin (?:short|summary|other words)\b", r"\bto (?:recap|summarize|summarise|sum up)\b", r"\bwhat this means is\b", r"\bthe takeaway (?:here )?is\b"),
        ),
        Rule(
            "hedge",
            "L",
            "empty caveat",
            "A caveat that informs of nothing.",
            "Cut it, or state the doubt itself.",
            (
                r"\bit'?s important to (?:note|remember|understand)\b",
                r"\bthat said,",
                r"\bthat being said\b",
                r"\bat the end of the day\b",
                r"\bin many ways\b",
                r"\bto some extent\b",
                r"\bit'?s worth (?:remembering|considering)\b",
            ),
        ),
        Rule("emoji", "L", "emoji", "Pictures stand among the words.", "Take them out.", (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]",)),
        Rule("fromto", "M", "from this to that", "A range stands in for naming things.", "Name the things.", (r"\bfrom\s+[\w-]+(?:\s+[\w-]+){0,2}\s+to\s+[\w-]+(?:\s+[\w-]+){0,2}\b(?=[,.;])",)),
        Rule("parallel", "H", "parallel run", "Units of one shape follow each other too often.", "Give one of them another shape."),
        Rule("doublet", "H", "balanced pair", "Two units of one length and shape, too often.", "Make the halves uneven, or drop one."),
        Rule("closer", "H", "short closing sentence", "Paragraph after paragraph ends on a short sentence.", "End on the sentence with the substance."),
        Rule("vague", "H", "nothing specific", "A long paragraph without number, name or quoted term.", "Name something that can be checked."),
        Rule("person", "M", "you for anyone", "'You' stands for anyone at all.", "Say who did it."),
        Rule("runt", "H", "sentence under the floor", "A sentence too short to carry a clause.", "Fold it into its neighbour."),
        Rule("opener", "M", "same opening word", "Sentences in a row begin alike.", "Begin one of them otherwise."),
        Rule("template", "M", "repeated phrase", "The same words in the same order, again.", "Word all but one of them otherwise."),
    )
}
CASE_SENSITIVE = frozenset({"colon", "emoji"})
SEVERITY_WEIGHT = {"H": 3.0, "M": 2.0, "L": 1.0}

FOOTPRINT = (
    r"\bi (?:didn'?t|did not) (?:believe|expect|think)\b",
    r"\bi expected\b",
    r"\bwe assumed\b",
    r"\bwe thought\b",
    r"\bi was (?:wrong|surprised|skeptical|sceptical)\b",
    r"\bwent looking for\b",
    r"\bi haven'?t found\b",
    r"\bi don'?t (?:have|know)\b",
    r"\bharder than i expected\b",
    r"\bi'?d rather\b",
    r"\bi wouldn'?t defend\b",
    r"\btook us longest\b",
    r"\bi'?m not claiming\b",
    r"\bmostly out of curiosity\b",
    r"\bi would genuinely\b",
    r"\bwe lose the most ground\b",
    r"\bit turned out\b",
    r"\bto my surprise\b",
    r"\bi (?:assumed|suspected|guessed|worried)\b",
    r"\bi (?:don'?t|do not|didn'?t|did not) know\b",
    r"\bi still (?:don'?t|do not)\b",
    r"\bi'?m afraid (?:of|that)\b",
    r"\bnobody had a (?:reason|good answer)\b",
)

DEVICES = {
    "simile": r"\b(?:like|as)\s+(?:a|an|the)\s+\w+",
    "question": r"\?",
    "direct_address": r"\byou\b",
    "imperative": r"(?m)(?:^|\.\s+)[A-Z][a-z]+(?:\s+\w+){0,3}[.!]",
    "repetition": r"\b(\w{4,})\b[^.]{0,60}\b\1\b",
    "dash_aside": r"\([^)]{3,60}\)",
    "negation_frame": r"\bnot\s+\w+,?\s+but\b",
    "conditional": r"\bif\b[^.]{5,80}\bthen\b|\bwere\s+it\s+not\b",
    "list": r"\b\w+,\s+\w+,\s+\w+\b",
    "quotation": r"[\"\x{201c}][^\"\x{201d}]{8,}[\"\x{201d}]",
}
SUBORDINATORS = r"\b(?:which|that|because|although|though|while|whereas|since|unless|until|whether|after|before|when|where|if)\b"
CONTRACTION = r"\b\w+['\x{2019}](?:t|s|re|ve|ll|d|m)\b"
VOWELS = r"[aeiouy]+"

THANKS = r"\bthanks?\s+you\b|\bthank\s+you\b"
SECOND = r"\b(?:you|your|you'?re|you'?d|you'?ll|you'?ve)\b"
FIRST_SINGULAR = r"\b(?:i|i'?m|i'?d|i'?ve|i'?ll|me|my|mine)\b"
FIRST_PLURAL = r"\b(?:we|we'?re|we'?d|we'?ve|us|our|ours)\b"
APPEAL = r"^(?:please\b|let me\b|let's\b|i'?d\b|i would\b|i want\b|i know\b|look\b|listen\b|imagine\b|consider\b|think about\b|remember\b)"

YEAR = r"\b(?:1[6-9]|20|21)\d{2}\b"
UNIT = r"\b\d+(?:\.\d+)?\s*(?:%|percent|fold|x|kb|mb|gb|ms|s|kg|g|mg|nm|um|mm|cm|km|bp|kDa)\b"
QUOTED_TERM = r"[\"\x{201c}][^\"\x{201d}]{2,40}[\"\x{201d}]"
CODE_TERM = r"`[^`]{2,60}`"
NUMBER_WORD = (
    r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
    r"|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|half|quarter|third|twice|dozen)\b"
)
NUMERAL = r"\b\d"
PROPER = r"(?<=[a-z,;:)\"'\s])\b[A-Z][a-zA-Z'\x{2019}-]{1,}"
QUOTED_SPAN = r"[\"\x{201c}][^\"\x{201d}\n]{1,80}[\"\x{201d}]|`[^`\n]{1,80}`"

NEGATOR = r"\b(?:not|no|never|nothing|none|nor|isn'?t|aren'?t|wasn'?t|doesn'?t|don'?t|didn'?t|hasn'?t|haven'?t|won'?t|can'?t|cannot|couldn'?t)\b"
STRONG_NEGATOR = r"\b(?:not|never|cannot|isn'?t|aren'?t|wasn'?t|doesn'?t|don'?t|didn'?t|hasn'?t|haven'?t|won'?t|can'?t|couldn'?t)\b"
LEAD = r"^(?:and|or|but|nor|then|so)\s+"
COORDINATION = r"\s+(?:and|or|nor)\s+"

#: suffixes of the coarse word classes, in the order they are tried
CLASS_SUFFIXES = (
    ("~adv", ("ly",)),
    ("~ing", ("ing",)),
    ("~ed", ("ed",)),
    ("~nom", ("tion", "sion", "ment", "ness", "ity", "ance", "ence")),
    ("~adj", ("ous", "ive", "able", "ible", "al", "ic", "ful", "less")),
)
