"""Vocabularies: categories of patterns, each strong or weak, as literal expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..schema import SEVERITY


@dataclass(frozen=True)
class Pattern:
    place: int
    category: str
    regex: str
    strong: bool

    @property
    def java(self) -> str:
        """Case and classes as Unicode has them."""
        return f"(?iuU){self.regex}"

    @property
    def severity(self) -> int:
        return SEVERITY.get(self.category, 0)


def lexicon(vocabulary: dict[str, list], enabled=None) -> list[Pattern]:
    """Patterns in order; a plain string is strong, an object says its `strength`. Categories that aren't enabled never reach a plan."""
    out = []
    for category, entries in vocabulary.items():
        for entry in entries:
            regex, strength = (entry, "strong") if isinstance(entry, str) else (entry["pattern"], entry.get("strength", "strong"))
            if enabled is None or category in enabled:
                out.append(Pattern(len(out), category, regex, strength == "strong"))
    return out


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _weak(*words: str) -> list[dict]:
    return [{"pattern": rf"\b{w}\b", "strength": "weak"} for w in words]


#: A vocabulary to begin with, and what softened text says instead; both files of one's own take their place.
DEFAULT = {
    "profanity": [rf"\b{w}\b" for w in (r"(?:god)?damn(?:ed|it)?", r"crap(?:py)?", r"bastards?", r"bloody hell", r"piss(?:ed|ing)?(?: off)?", r"arse(?:hole)?s?", r"bollocks", r"screw you")] + _weak("hell", "jerks?", "sucks?"),
    "drugs": [rf"\b{w}\b" for w in (r"cocaine", r"heroin", r"meth(?:amphetamine)?", r"crack pipes?", r"snort(?:ed|ing)? (?:coke|a line)", r"shoot(?:ing)? up heroin", r"ecstasy pills?", r"overdos(?:e|ed|ing)", r"drug deal(?:er|ers|ing)?")] + _weak("high", "stoned", "joints?", "dealers?", "pills", "coke"),
    "sex": [rf"\b{w}\b" for w in (r"naked", r"have sex", r"having sex", r"make love", r"making love", r"strip(?:per|pers| club| clubs)", r"prostitut(?:e|es|ion)")] + _weak("bed", "undress(?:ed|ing)?", "kiss me", "sleep(?:ing)? with"),
    "violence": [rf"\b{w}\b" for w in (r"murder(?:ed|er|ers|ing)?", r"stab(?:bed|bing)", r"behead(?:ed|ing)?", r"tortur(?:e|ed|ing)", r"slaughter(?:ed|ing)?")] + _weak("kill(?:ed|ing)?", "shot", "blood"),
}
SOFTER = {"damn": "darn", "damned": "darned", "goddamn": "gosh darn", "dammit": "darn it", "crap": "junk", "bastard": "rascal", "bastards": "rascals", "bloody hell": "good grief", "hell": "heck", "pissed off": "annoyed", "arse": "rear", "screw you": "get lost", "sucks": "stinks", "jerk": "fool"}


def vocabulary_of(path: str | None = None) -> dict[str, list]:
    """The vocabulary of a JSON file (category: patterns), or DEFAULT."""
    return load_json(path) if path else DEFAULT


def replacements_of(path: str | None = None) -> dict[str, str]:
    """The replacements of a JSON file (phrase: phrase), or SOFTER."""
    return load_json(path) if path else SOFTER
