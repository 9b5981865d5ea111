"""Wording cues shared by the pair and truncation operators: refusals, reservations, placeholders.

Texts are compared in one lower-case Latin form, so that a cue is written once for both scripts of Uzbek.
"""

from __future__ import annotations

import re
import unicodedata

#: Uzbek Cyrillic letters in their Latin spelling.
_UZ = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "x", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "sh", "ъ": "'", "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ў": "o'", "қ": "q", "ғ": "g'", "ҳ": "h", "і": "i",
}
_APOSTROPHES = "".join(map(chr, (0x2018, 0x2019, 0x2BB, 0x2BC, 0xB4, 0x60, 0x2B9, 0x2032, 0xFF07)))
_UNSEEN = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)))
_APOSTROPHE = str.maketrans(dict.fromkeys(_APOSTROPHES, "'") | dict.fromkeys(_UNSEEN, None))
_TRANSLATE = str.maketrans(_UZ)
_INITIAL = re.compile(r"\bе")

#: Values that hold no content, in the form of `plain` without outer marks.
PLACEHOLDERS = frozenset(
    ["", "n/a", "na", "n.a", "null", "none", "nil", "nan", "end", "answer", "javob", "otvet", "antwort", "cevap", "tbd", "todo", "empty", "undefined", "unknown", "no answer", "x", "xx", "xxx", "yo'q", "question", "savol", "-"]
)

#: Ways to decline, English and Uzbek; each is matched inside `plain` text.
REFUSAL = re.compile(
    r"\b(?:(?:i|we) (?:\w+ ){0,2}(?:cannot|can't|can not|could not|couldn't|am unable|are unable|won't|will not|must decline|have to decline|decline|refuse|am not able|are not able|am not allowed|am not permitted)\b"
    r"|i (?:do not|don't|dont) (?:know|have)|i have no (?:idea|answer|information)|unable to (?:answer|respond|help|say|provide)|not able to (?:answer|respond|help|discuss|provide)"
    r"|rather not (?:answer|say|respond|discuss)|must decline|decline to (?:answer|respond)|refuse to (?:answer|respond)"
    r"|not enough (?:\w+ ){0,4}(?:answer|respond|say)|not enough for an answer|insufficient (?:evidence|information|context|data)|(?:evidence|information|context|passages?) (?:is|are|was|were) (?:not enough|insufficient|not sufficient)"
    r"|no answer (?:\w+ ){0,8}(?:can be|is|could be)|cannot be (?:answered|given)|can't be answered|could not be answered|(?:there is )?nothing in the (?:context|passages?|text|evidence)|nothing (?:here )?lets me answer"
    r"|not covered by|falls? outside (?:of )?(?:what|the)|outside (?:of )?(?:what i|my|the scope)|guidelines (?:prevent|forbid|do not allow)|prevents? me from|not (?:something|a topic) i can|as an (?:ai|assistant)\b"
    r"|cannot help|can't help|cannot assist|can't assist|cannot comment|cannot discuss|cannot provide|consult your (?:teacher|instructor)"
    r"|bilmayman|bila olmayman|bilmadim|javob bera olma\w*|yordam bera olma\w*|ayta olma\w*|bosh tort\w*|rad etaman|javob bermayman|javob berishni istamayman|javob berish\w* (?:uchun )?(?:\w+ ){0,2}(?:yetarli emas|mumkin emas)"
    r"|yetarli emas|javob berib bo'lmaydi|javob berish imkonsiz|javob yo'q|ma'lumot (?:topilmadi|yo'q|yetarli)|hech narsa (?:yo'q|topilmadi|deyilmagan|aytilmagan)|javob topilmadi|topilmadi|o'qituvchingizga murojaat|qoidalar\w* (?:\w+ ){0,6}(?:ruxsat bermay\w*|taqiqla\w*|yo'l qo'ymay\w*|imkon bermay\w*)|ruxsat (?:berilmagan|bermaydi|etilmagan)|gapira olma\w*|muhokama qila olma\w*|fikr bildira olma\w*|so'rov\w* (?:\w+ ){0,5}tashqari\w*|doira\w*dan tashqari\w*|qamrab olinmagan|yoritilmagan)"
)

#: What a refusal speaks about; a cue alone in a long sentence of content is not one.
ABOUT = re.compile(r"\b(?:answer(?:s|ed|ing)?|respond|response|questions?|request|help|evidence|context|passages?|information|guidelines|chunks|teacher|discuss|comment\w*|know|javob\w*|savol\w*|so'rov\w*|yordam\w*|dalillar\w*|ma'lumot\w*|matnda|bilmayman|bilmadim|o'qituvchi\w*|qoida\w*|mavzu\w*|gapira|kontekst\w*)")

_ODD = re.compile("[^\x00-\x7fЀ-ӿʻʼ‘’À-ÿα-ω«»ığşĞİŞ]|[a-z][а-яіѕјһ]|[а-яіѕјһ][a-z]")


def hinted(text: str) -> bool:
    """`text`, in any form, holds a REFUSAL."""
    return bool(REFUSAL.search(plain(text)))


#: Between a reservation and the answer after it.
TURN = re.compile(r"(?:, but |; but |; still,? |, still,? |; however,? |, however,? |; nevertheless,? |, yet |, though |, although |: |, ammo |; ammo |, lekin |; lekin |, biroq |, shunga qaramay,? |; shunday bo'lsa ham,? | - | — | – )")

_MIXED = re.compile(r"[a-z]['а-яіјѕһ]*[а-яіјѕһ]|[а-яіјѕһ]['a-z]*[a-z]")
_TOKEN = re.compile(r"[^\W\d_]+")
_ALIKE = str.maketrans("аеорсухіјѕһкмтвн", "aeopcyxijshkmtbh")

_SPACE = re.compile(r"\s+")
# cheap tests: without these characters the steps behind them change nothing
_MARK = re.compile(f"[{_APOSTROPHES}{_UNSEEN}]")
_LATIN = re.compile("[a-z]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")


def unscripted(text: str) -> str:
    """Compatibility forms, invisible characters and letters of another script inside a word resolved."""
    if _MARK.search(text):
        text = text.translate(_APOSTROPHE)
    text = unicodedata.normalize("NFKC", text).lower()
    if _LATIN.search(text) and _CYRILLIC.search(text) and _MIXED.search(text):
        text = _TOKEN.sub(lambda m: m.group().translate(_ALIKE) if re.search("[a-z]", m.group()) else m.group(), text)
    return text


def latin(text: str) -> str:
    """Cyrillic letters of a lower-case text in their Latin spelling."""
    return _INITIAL.sub("ye", text).translate(_TRANSLATE) if _CYRILLIC.search(text) else text


def plain(text: str) -> str:
    """Lower case, one form of apostrophe, Latin letters, single blanks."""
    if not text.isascii():
        text = latin(unscripted(text))
        return _SPACE.sub(" ", text).strip()
    return " ".join(text.lower().replace("`", "'").split())


_LATIN_UZ = sorted(((b, a) for a, b in _UZ.items() if b and a not in "щыіцъэ" and len(b) > 0), key=lambda x: -len(x[0]))
_TO_CYRILLIC = re.compile("|".join(re.escape(a) for a, _ in _LATIN_UZ))


def cyrillic(text: str) -> str:
    """Uzbek in Latin letters in its Cyrillic spelling, in lower case; good enough for letter statistics."""
    table = dict(_LATIN_UZ)
    return _TO_CYRILLIC.sub(lambda m: table[m.group()], text.lower().translate(_APOSTROPHE))


def empty(text: str | None) -> bool:
    """Null, blank, or only a placeholder or marks."""
    if text is None:
        return True
    if len(text) > 60:
        return not any(map(str.isalnum, text))
    bare = plain(text).strip(" .,:;!?…-–—_*#<>[](){}/\\|\"'«»“”=+~^" + _UNSEEN)
    return bare in PLACEHOLDERS or not any(map(str.isalnum, bare))


def declines(clause: str) -> bool:
    """`clause` in plain form says that no answer is given, and nothing after that."""
    if not REFUSAL.search(clause) or not ABOUT.search(clause):
        return False
    turn = None
    for turn in TURN.finditer(clause):
        pass
    if turn is None:
        return True
    left, right = clause[: turn.start()], clause[turn.end() :]
    if REFUSAL.search(right):
        return True
    return len(right.split()) < 4 or clause[turn.start() : turn.end()].strip() == ":" and len(left.split()) <= 3 and bool(REFUSAL.search(left)) and bool(ABOUT.search(right))
