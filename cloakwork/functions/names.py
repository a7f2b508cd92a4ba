"""Names of people in texts: a kernel over Arrow batches, as the grammar needs state.

Evidence, strongest first: the field a value sits in (``full_name: ...``, columns of
embedded tables, quoted pairs), a cue or salutation before it, names of a lexicon, and
runs of Title Case words that are not ordinary words, places or organisations.

Lexicon: the built-in one is small; ``Lexicon.read`` takes a table (name, kind) with kinds
``given``, ``family``, ``ambiguous`` and ``ordinary``.  It is shipped to the workers, so
its size is checked.  Defined results: null and empty texts give no spans; of spans that
start together the first found wins; offsets count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names that a lexicon may hold at most, as each worker keeps it in memory.
LEXICON_LIMIT = 1_000_000
NAME_SPANS = "array<struct<s:int,m:string,confidence:string>>"
CONFIDENCES = ("low", "medium", "high")
KINDS = ("full_name", "non_latin_name")
#: Texts that are Python objects at once; given names that one screen holds.
SLICE, SCREENED = 500, 1000


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# ---- fixed values ----------------------------------------------------------------
STRONG_KEYS = _set(
    "full_name fullname first_name firstname last_name lastname given_name givenname family_name familyname surname forename middle_name maiden_name legal_name person_name preferred_name "
    "account_holder account_holder_name cardholder card_holder cardholder_name card_holder_name beneficiary beneficiary_name next_of_kin emergency_contact emergency_contact_name signatory "
    "الاسم_الكامل الاسم_الأول الاسم_الاول اسم_العائلة اسم_الأب اسم_الاب اسم_الأم اسم_الام اسم_الموظف اسم_العميل اسم_المريض اسم_المستفيد اسم_صاحب_الحساب اسم_حامل_البطاقة اسم_المسافر"
)
ROLES = _set(
    "employee customer client patient contact owner holder applicant passenger guest member student parent guardian spouse father mother recipient sender driver nominee tenant landlord buyer seller "
    "manager supervisor doctor physician nurse author reviewer approver witness sponsor visitor candidate borrower insured policyholder subscriber traveler traveller representative staff teacher child"
)
WEAK_KEYS = _set(
    "name customer client employee contact owner holder patient passenger guest member author assignee reporter manager recipient sender applicant tenant driver student display_name displayname "
    "contact_person attn attention signed_by prepared_by approved_by reviewed_by requested_by assigned_to created_by updated_by modified_by submitted_by الاسم اسم العميل الموظف المريض المستفيد المالك مقدم_الطلب"
)
THING_TOKENS = _set(
    "company companies org organization organisation business product file filename host hostname server database db table column schema app application service bucket branch project sheet domain device brand "
    "plan model package pkg class category type tag label key field event job task city country street building team department dept division unit bank vendor supplier merchant store shop course module repo "
    "repository image container cluster region zone queue topic env environment variable font color colour folder dir directory path url uri link site website page section step stage workflow pipeline action "
    "script function method test metric feature flag role group channel workspace agent bot tool report document template policy rule attribute property entity resource "
    "الشركة المنتج الملف المدينة الدولة القسم الإدارة الادارة البنك الفرع المشروع الجهة المؤسسة الخدمة التطبيق"
)
LOGIN_KEYS = _set("username user_name login userid user_id handle")
PLACEHOLDERS = _set("n/a na none null nil unknown tbd tba undefined anonymous redacted test user admin administrator system root guest nobody somebody someone everyone all self me you true false yes no") | {"غير معروف", "لا يوجد", "غير متوفر"}
PARTICLES = _set("al el bin bint ibn abu bu abd abdul de dela della del da di dos das du van von der den la le y ul ud bn st بن بنت ابن آل عبد أبو ابو أم ام بو")
HYPHEN_HEADS = _set("al el abu abd abdul bin ben ibn bint")
ORG_ENDINGS = _set(
    "street st road rd avenue ave boulevard blvd highway hwy lane square plaza city district emirate island airport mall tower towers centre center mosque masjid university college school academy institute "
    "hospital clinic hotel resort stadium museum library souk station terminal marina bank group holding holdings llc fze fzco fzllc pjsc psc ltd limited inc corp corporation company gmbh plc authority ministry "
    "council municipality court foundation association club trading logistics technologies technology solutions services systems consulting consultancy partners enterprises industries investments properties "
    "cloud studio code platform support report plan airways airlines telecom media news department dept division team office committee board directorate sector unit"
)
ORG_HEADS_AR = _set("شارع طريق مدينة منطقة حي جزيرة إمارة امارة مطار ميناء مركز مول برج مسجد جامع جامعة كلية مدرسة معهد أكاديمية اكاديمية مستشفى عيادة فندق بنك مصرف شركة مؤسسة مجموعة وزارة هيئة دائرة مجلس بلدية محكمة محاكم نادي ملعب متحف مكتبة سوق محطة حديقة منتزه قسم إدارة ادارة فرع مشروع")
PLACES = (
    "abu dhabi", "al ain", "ras al khaimah", "umm al quwain", "al dhafra", "al reem", "al barsha", "al quoz", "al nahda", "al qusais", "al karama", "al mamzar", "jumeirah lake towers", "business bay",
    "downtown dubai", "palm jumeirah", "dubai silicon oasis", "saudi arabia", "united arab emirates", "united states", "united kingdom", "new york", "new jersey", "new delhi", "new zealand",
    "san francisco", "los angeles", "las vegas", "san diego", "san jose", "hong kong", "sri lanka", "south africa", "north america", "south america", "costa rica", "el salvador", "puerto rico",
    "rio de janeiro", "buenos aires", "kuala lumpur", "cape town", "saint petersburg", "tel aviv",
)
#: Whole runs of Arabic words.
PLACES_AR = (
    "أبو ظبي", "ابو ظبي", "رأس الخيمة", "راس الخيمة", "أم القيوين", "ام القيوين", "الإمارات العربية المتحدة", "الامارات العربية المتحدة", "المملكة العربية السعودية", "المملكة المتحدة",
    "الولايات المتحدة", "الولايات المتحدة الأمريكية",
)
GREETINGS = "hi|hello|hey|dear|thanks|thank you|thx|cheers|regards|kind regards|best regards|best wishes|sincerely|bye|welcome|congrats|congratulations"
TITLES = "mr|mrs|ms|miss|mx|dr|prof|eng|sheikh|sheikha|attn"
SALUTATIONS_AR = _set("السيد السيدة الآنسة الانسة الأستاذ الاستاذ الأستاذة الاستاذة الدكتور الدكتورة د المهندس المهندسة م الشيخ الشيخة سعادة معالي سمو الأخ الاخ الأخت الاخت عزيزي عزيزتي مرحبا أهلا اهلا شكرا تحياتي المرسل المستلم")
CUE = r"(?:name|customer|client|employee|staff|contact|owner|applicant|holder|beneficiary|patient|passenger|guest|member|author|(?:signed|prepared|reviewed|approved)[ \t]*by|attn|mr|mrs|ms|miss|dr|prof|eng|sheikh|الاسم|اسم|السيد|السيدة|الآنسة|الدكتور|المهندس|الشيخ|العميل|الموظف)[:\s]*\Z"
OPENERS = _set("the a an this that these those and or but so then when if also today yesterday tomorrow please ask tell call email")
# ---- end of fixed values ---------------------------------------------------------

#: Built-in lexicon and ordinary words; a fuller list is a parameter.
GIVEN = "Ahmed Mohammed Mohamed Muhammad Abdullah Abdulla Khalid Omar Ali Hassan Hussein Ibrahim Yusuf Fatima Aisha Mariam Noura Layla Salem Saeed Rashid Sultan Zayed Hamdan Khalifa Rajesh Priya Anil Sanjay Deepa Maria Jose Juan Carlos Ana John James Sarah Emily Michael David Robert Jane Peter Paul Anna Thomas William Elena Sofia Lucas Pierre Hans Claudia محمد أحمد علي فاطمة عائشة مريم خالد عمر حسن حسين راشد سلطان سعيد عبدالله نورة"
FAMILY = "Mansouri Kaabi Hashimi Maktoum Nahyan Suwaidi Mazrouei Ketbi Shamsi Kumar Sharma Nair Patel Singh Santos Cruz Reyes Garcia Lopez Smith Johnson Connor Brown Miller Doe Müller Schmidt Dubois Rossi المنصوري الكعبي الهاشمي السويدي المزروعي"
AMBIGUOUS = "will hope grace mark may bill أمل نور"
ORDINARY = (
    "the of in for a an and or to from with by at on is are was were be have has had do does will would could should may might must can not no but if then when where why how all each every more most other some such than "
    "too very now only own same so also as it its this that these those he she they we you his her their our your my who which what new old first last next previous total count value data report table column row field "
    "name type date time year month day number id code status state core rule summary overview section note example title page version review result details database connection server client service request error config "
    "setting user account file folder path output input source target format key token secret password access policy security privacy compliance audit company business customer employee department manager contact address "
    "phone email office invoice payment amount price project product system full passport protection processing officer visa bank card please today january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday"
)
_STRIP_AR = regex.compile(r"[ً-ٰٟۖ-ۭـ]")
_FOLD_AR = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ی": "ي", "ک": "ك"})
_ARABIC = re.compile(r"[؀-ۿݐ-ݿࢠ-ࣿ]")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """The key under which spellings of a name meet."""
    if word.isascii() and word.isalpha():
        return word.lower()
    if _ARABIC.search(word):
        return _STRIP_AR.sub("", unicodedata.normalize("NFC", word)).translate(_FOLD_AR)
    plain = regex.sub(r"[\p{M}’'`]", "", unicodedata.normalize("NFD", word))
    return regex.sub(r"^\P{L}+|\P{L}+$", "", plain).lower()


@lru_cache(maxsize=200_000)
def _family_key(key: str) -> str:
    return regex.sub(r"^(?:(?:al|el)-?|ال)(?=.{3})", "", key)


@dataclass(frozen=True)
class Lexicon:
    given: frozenset[str] = field(default_factory=lambda: frozenset(map(fold, GIVEN.split())))
    family: frozenset[str] = field(default_factory=lambda: frozenset(_family_key(fold(w)) for w in FAMILY.split()))
    ambiguous: frozenset[str] = field(default_factory=lambda: frozenset(map(fold, AMBIGUOUS.split())))
    ordinary: frozenset[str] = field(default_factory=lambda: frozenset(ORDINARY.split()))

    @staticmethod
    def read(spark: SparkSession, path: str) -> Lexicon:
        """The built-in lexicon and a table (name, kind)."""
        rows = spark.read.parquet(path).select("name", "kind").where("name is not null").distinct()
        if rows.count() > LEXICON_LIMIT:
            raise ValueError(f"a lexicon holds {LEXICON_LIMIT} names at most")
        more = defaultdict(set)
        for name, kind in rows.toLocalIterator():
            more[kind].add(name.lower() if kind == "ordinary" else _family_key(fold(name)) if kind == "family" else fold(name))
        own = Lexicon()
        return replace(own, **{k: getattr(own, k) | more[k] for k in ("given", "family", "ambiguous", "ordinary")})

    def is_given(self, w: str) -> bool:
        return fold(w) in self.given

    def is_name(self, w: str) -> bool:
        k = fold(w)
        return k in self.given or _family_key(k) in self.family

    def is_ordinary(self, w: str) -> bool:
        return w.lower().strip(".'’") in self.ordinary

    def is_sure(self, w: str) -> bool:
        return self.is_name(w) and fold(w) not in self.ambiguous and not self.is_ordinary(w)


def key_name(key: str) -> str:
    k = regex.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key.strip().strip("\"'`")).lower()
    k = regex.sub(r"[^a-z0-9؀-ۿ]+", "_", k).strip("_")
    return regex.sub(r"_(?:en|ar|eng|english|arabic)$", "", k)


def key_grade(key: str) -> str | None:
    """``strong`` if a key always holds a person's name, ``weak`` if it may."""
    k = key_name(key)
    parts = [p for p in k.split("_") if p]
    if not parts or len(k) > 48 or k in LOGIN_KEYS:
        return None
    if k in STRONG_KEYS:
        return "strong"
    if not THING_TOKENS.isdisjoint(parts):
        return None
    ends_strong = any("_".join(parts[i:]) in STRONG_KEYS for i in range(1, len(parts)))
    if ends_strong or (len(parts) > 1 and parts[-1] == "name" and parts[-2] in ROLES):
        return "strong"
    return "weak" if k in WEAK_KEYS else None


def organisation(words: list[str]) -> bool:
    clean = [w.rstrip(".,'’").lower() for w in words]
    clean = [w for w in clean if w]
    if not clean:
        return False
    line = " ".join(clean)
    if _ARABIC.search(line):
        return clean[0] in ORG_HEADS_AR or line in PLACES_AR
    return clean[-1] in ORG_ENDINGS or any(f" {p} " in f" {line} " for p in PLACES)


_SHAPE = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’. -]*(?:, ?[\p{L}\p{M}][\p{L}\p{M}'’. -]*)?")
_WORD = r"(?:[A-Z]['’][A-Z][a-z]+|(?:Mc|Mac)?[A-Z][a-z]+(?:-[A-Z]?[a-z]+)*)"
_RUN = regex.compile(rf"\b(?!(?:{GREETINGS.title()}|{TITLES.title()}|Thank|Kind|Best)\b){_WORD}(?:[ \t]+(?:(?:bin|bint|ibn|al|el|de|del|dela|della|da|das|dos|du|van|von|der|den|le|la|di|y)[ \t]+){{0,2}}{_WORD})+\b", regex.A)
_CUE = regex.compile(CUE, regex.I)
#: The start of a Markdown heading: a title of a section, not a person.
_HEADING = regex.compile(r"\s{0,3}#{1,6}\s[^\n]*")
_PAIR = regex.compile(r"""(["'])([^"'\n]{1,48})\1[ \t]*[:=][ \t]*(["'])((?:(?!\3)[^\\\n]|\\.){0,120})\3""")
_LABEL = regex.compile(r"^[ \t]*(?:[-*•][ \t]+)?([\p{L}_][\p{L}\p{M}\p{N} _.$-]{0,48}?)[ \t]*([:：=])[ \t]*(?![:=/])([^\n]+)$", regex.M)
_SALUTATION = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:({GREETINGS})|({TITLES}))(?![\p{{L}}\p{{M}}])\.?[ \t]*[,:!]?[ \t]*(?:\r?\n[ \t]*)?([A-Za-zÀ-ɏ][\w'’-]*)", regex.I)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’-]*")
#: A capital from which a run may start: its word and up to two particles stand before another capital.
_START = re.compile(r"[A-Z](?=[A-Za-z'’-]*[ \t]+(?:(?:bin|bint|ibn|al|el|de|del|dela|della|da|das|dos|du|van|von|der|den|le|la|di|y)[ \t]+){0,2}[A-Z])")
#: The marks that letters of _LATIN decompose into, and what else fold takes out.
_MARKS = re.compile(r"[\u0300-\u036f’'`]+")


def _key_parts() -> list[str]:
    """Of each key that may hold a person's name, the longest part: a text without any of them has no such key."""
    parts = {max(k.split("_"), key=lambda p: (p == "name", len(p))) for k in STRONG_KEYS | WEAK_KEYS} | {"name"}
    return sorted(p for p in parts if not any(q != p and q in p for q in parts))


#: What texts with evidence of a source have, in RE2's dialect, for whole batches; other texts skip the source.
SCREENS = {
    "fields": "(?i)" + "|".join(_key_parts()),
    "title_case": _START.pattern.replace("(?=", "(?:"),
    "salutations": "(?i)(?:^|[^A-Za-z])(?:" + f"{GREETINGS}|{TITLES}".replace("i", "[iİı]") + ")(?:[^A-Za-z]|$)",
}
_AR = regex.compile(r"[ء-ٟٮ-ۓە-ۯۺ-ۿݐ-ݿࢠ-ࣿ]+")


def _given_screen(given: frozenset[str]) -> str:
    """The words of _LATIN that fold to a given name, in RE2's dialect; cases are spelled out, as folding would widen the edges."""
    variants = defaultdict(str)
    for x in map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))):
        variants[_MARKS.sub("", unicodedata.normalize("NFD", x)).lower()] += x
    words = "|".join("".join(f"[{variants.get(c) or re.escape(c)}]['’]*" for c in w) for w in sorted(given) if w and not _ARABIC.search(w))
    return f"(?:^|[^A-Za-zÀ-ɏ]|[×÷])(?:{words})['’×÷-]*(?:[^A-Za-zÀ-ɏ]|$)" if words else r"[^\x00-\x{10FFFF}]"


class Finder:
    """All evidence over one lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        plain = {w for w in lexicon.given if w.isascii() and w.isalpha()}
        self.cased = plain | {w.upper() for w in plain}
        self.screens = SCREENS | ({"caseless": _given_screen(lexicon.given)} if len(lexicon.given) <= SCREENED else {})

    # -- fields ------------------------------------------------------------------
    def shaped(self, value: str) -> list[str] | None:
        words = value.split()
        fits = 0 < len(words) <= 6 and len(value) <= 80 and value.lower() not in PLACEHOLDERS and _SHAPE.fullmatch(value)
        return words if fits and not organisation(words) else None

    def personal(self, value: str) -> bool:
        """Whether a value looks like a person without help of its key."""
        words = [w for w in self.shaped(value.replace(",", "")) or () if w.lower() not in PARTICLES]
        if len(words) < 2 or any(self.lexicon.is_ordinary(w) or sum(c.isalpha() for c in w) < 2 for w in words):
            return False
        cases = {"upper" if w.isupper() else "lower" if w.islower() else "title" if w[0].isupper() else "mixed" for w in words if w.lower() != w.upper()}
        return len(cases) <= 1 and "mixed" not in cases and any(map(self.lexicon.is_sure, words))

    def field_values(self, text: str) -> Iterator[tuple[str, int, str]]:
        for m in _PAIR.finditer(text) if '"' in text or "'" in text else ():
            yield m[2], m.start(4), m[4]
        for m in _LABEL.finditer(text) if any(c in text for c in ":=：") else ():
            key, rest = m[1], m[3]
            if m[2] == "=" and key.split():
                key = key.split()[-1]
            if rest[0] in "\"'":
                end = rest.find(rest[0], 1)
                if end > 0:
                    yield key, m.start(3) + 1, rest[1:end]
            else:
                yield key, m.start(3), regex.split(r"[,;#|{}\[\]<>()]", rest, maxsplit=1)[0]
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, line.rstrip("\r")))
            at += len(line) + 1
        for filled, block in groupby(lines, lambda x: bool(x[1].strip())):
            if filled:
                yield from self.table(list(block))

    @staticmethod
    def cells(line: str, mark: str, outer: bool) -> list[tuple[int, str]]:
        quoted = r'[ \t]*"(?P<q>[^"]*)"[^%s]*|' % mark if mark in ",;" else ""
        out = []
        for m in regex.finditer(rf"(?:^|(?<={regex.escape(mark)}))(?:{quoted}(?P<v>[^{regex.escape(mark)}]*))", line):
            name = "v" if m["v"] is not None else "q"
            out.append((m.start(name), m[name]))
        return out[1 if line.lstrip().startswith("|") else 0 : -1 if line.rstrip().endswith("|") else None] if outer else out

    def table(self, lines: list[tuple[int, str]]) -> Iterator[tuple[str, int, str]]:
        """Cells of the person columns of a run of non-empty lines, the first of which is the header."""
        for mark in "\t|,;":
            if mark not in lines[0][1]:
                continue
            outer = mark == "|" and regex.fullmatch(r"\s*\|.*\|\s*", lines[0][1]) is not None
            header = self.cells(lines[0][1], mark, outer)
            if not any(key_grade(key) for _, key in header):
                continue
            rows = [(s, self.cells(x, mark, outer)) for s, x in lines[1:] if not regex.match(r"\s*\|?\s*:?-{2,}", x)]
            even = [r for r in rows if len(r[1]) == len(header)]
            if len(header) >= 2 and rows and len(even) >= 0.6 * len(rows):
                for k, (_, key) in enumerate(header):
                    if key_grade(key):
                        yield from ((key, s + cells[k][0], cells[k][1]) for s, cells in even)
                return

    def fields(self, text: str) -> Iterator[tuple[int, str, str]]:
        found, votes = [], defaultdict(list)
        for key, at, raw in self.field_values(text):
            value, grade = raw.strip(), key_grade(key)
            if value and grade:
                found.append((key_name(key), grade, at + len(raw) - len(raw.lstrip()), value))
                if grade == "weak":
                    votes[found[-1][0]].append(self.personal(value))
        for key, grade, at, value in found:
            v = votes[key]
            share = sum(v) / len(v) if len(v) >= 3 else None
            trusted = grade == "strong" or (share is not None and share >= 0.6)
            if self.shaped(value) if trusted else (share is None or share >= 0.4) and self.personal(value):
                yield at, value, "high"

    # -- running text --------------------------------------------------------------
    def confidence(self, text: str, at: int, words: list[str]) -> str:
        if _CUE.search(text[max(0, at - 24) : at]):
            return "high"
        return "medium" if sum(map(self.lexicon.is_sure, words)) >= 2 else "low"

    def openers(self, words: list[str]) -> int:
        lex, k = self.lexicon, 0
        while k < len(words) - 1 and (words[k].lower() in OPENERS or (lex.is_ordinary(words[k]) and not lex.is_given(words[k]))):
            k += 1
        return k

    def title_run(self, words: list[str], text: str, at: int) -> bool:
        for w in words:
            parts = w.lower().split("-")
            if len(parts) > 1 and parts[0] not in HYPHEN_HEADS and not any(map(self.lexicon.is_sure, parts)):
                return False
        if organisation(words):
            return False
        if _CUE.search(text[max(0, at - 24) : at]):
            return True
        line = text[text.rfind("\n", 0, at) + 1 : at]
        return not _HEADING.fullmatch(line) and not all(map(self.lexicon.is_ordinary, words))

    def title_case(self, text: str) -> Iterator[tuple[int, str, str]]:
        last = 0
        for start in _START.finditer(text):
            m = _RUN.match(text, start.start()) if start.start() >= last else None
            if not m:
                continue
            last = m.end()
            parts = [(w.start(), w[0]) for w in regex.finditer(r"\S+", m[0])]
            cut = self.openers([w for _, w in parts])
            rest = [w for _, w in parts[cut:]]
            if cut and (len(rest) < 2 or not rest[0][0].isupper() or not any(map(self.lexicon.is_sure, rest))):
                continue
            at, value = m.start() + parts[cut][0], m[0][parts[cut][0] :]
            if self.title_run(rest, text, at):
                yield at, value, self.confidence(text, at, rest)

    def lists(self, words: set[str]) -> bool:
        """Whether any of the words in one case folds to a given name; those that are not plain are folded together."""
        if not self.cased.isdisjoint(words):
            return True
        rest = "\n".join(w for w in words if not (w.isascii() and w.isalpha()) and (w.islower() or w.isupper()))
        folded = _MARKS.sub("", unicodedata.normalize("NFD", rest)).lower() if rest else ""
        return any(w.strip("-×÷") in self.lexicon.given for w in folded.split("\n")) if folded else False

    def caseless(self, text: str) -> Iterator[tuple[int, str, str]]:
        """Runs of two to five listed names in one case, a given name first."""
        lex, run = self.lexicon, []
        if not self.lists(set(_LATIN.findall(text))):
            return

        def settle() -> Iterator[tuple[int, str, str]]:
            while run and run[-1][0].lower() in PARTICLES:
                run.pop()
            names = [m for m in run if m[0].lower() not in PARTICLES]
            if 2 <= len(names) and len(run) <= 5 and lex.is_given(run[0][0]):
                yield run[0].start(), text[run[0].start() : run[-1].end()], "medium"
            run.clear()

        for m in _LATIN.finditer(text):
            case = m[0].islower() or (m[0].isupper() and len(m[0]) > 1)
            fits = case and (lex.is_sure(m[0]) or (run and m[0].lower() in PARTICLES))
            if run and (not fits or m[0].islower() != run[0][0].islower() or text[run[-1].end() : m.start()].strip(" \t")):
                yield from settle()
            if fits and (run or lex.is_given(m[0])):
                run.append(m)
        yield from settle()

    def salutations(self, text: str) -> Iterator[tuple[int, str, str]]:
        lex = self.lexicon
        for m in _SALUTATION.finditer(text, overlapped=True):
            w = m[3]
            if not lex.is_ordinary(w) and (lex.is_given(w) or (m[2] and lex.is_name(w))) and (fold(w) not in lex.ambiguous or w[0].isupper()):
                yield m.start(3), w, "high"

    def repeats(self, text: str, names: list[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
        """Parts of full names found elsewhere in the text, outside the spans found so far."""
        parts = {w for _, v, _ in names if len(v.split()) > 1 for w in v.split() if self.lexicon.is_sure(w)}
        taken = sorted((s, s + len(v)) for s, v, _ in names)
        k = 0
        for m in regex.finditer(r"[\p{L}\p{M}'’-]+", text) if parts else ():
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if m[0] in parts and not (k < len(taken) and taken[k][0] < m.end()):
                yield m.start(), m[0], "medium"

    def latin(self, text: str, without: frozenset[str] = frozenset()) -> list[tuple[int, str, str]]:
        """without: sources that are known to find nothing."""
        first: dict[int, tuple[int, str, str]] = {}
        for source in ("fields", "title_case", "caseless", "salutations"):
            for x in getattr(self, source)(text) if source not in without else ():
                if not _ARABIC.search(x[1]):
                    first.setdefault(x[0], x)
        return _disjoint([*first.values(), *self.repeats(text, list(first.values()))])

    def arabic(self, text: str, without: frozenset[str] = frozenset()) -> list[tuple[int, str, str]]:
        """Runs of Arabic words: a given name, then nasab, given and family names, seven words at most."""
        lex, found = self.lexicon, [x for x in self.fields(text) if _ARABIC.search(x[1])] if "fields" not in without else []
        tokens = list(_AR.finditer(text))
        near = [k > 0 and not text[tokens[k - 1].end() : t.start()].strip(" \t") for k, t in enumerate(tokens)]
        heads, nasab = _set("عبد ابو ام"), _set("بن بنت ابن ال")
        k = 0
        while k < len(tokens):
            end, size, sure = k, 0, 0
            while end < len(tokens) and end - k < 7 and (end == k or near[end]):
                w = fold(tokens[end][0])
                ahead = fold(tokens[end + 1][0]) if end + 1 < len(tokens) and near[end + 1] else ""
                if w in heads | nasab and (w in heads or size) and ahead:
                    end, size, sure = end + 2, size + 1, sure + 1
                elif lex.is_name(tokens[end][0]) or (size and regex.fullmatch(r"ال.{2,}ي", w)):
                    end, size, sure = end + 1, size + 1, sure + (w not in lex.ambiguous)
                else:
                    break
            cue = size and sure and k > 0 and (tokens[k - 1][0] in SALUTATIONS_AR or _CUE.search(text[max(0, tokens[k].start() - 24) : tokens[k].start()]))
            words = [t[0] for t in tokens[k:end]]
            if size and sure and (size > 1 or cue or end - k > 1) and (cue or lex.is_given(words[0]) or fold(words[0]) in heads) and not organisation(words):
                found.append((tokens[k].start(), text[tokens[k].start() : tokens[end - 1].end()], "high" if cue else "medium"))
                k = end
            else:
                k += 1
        return _disjoint([*found, *self.repeats(text, found)])


def _disjoint(found: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    out, last = [], 0
    for s, v, c in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if s >= last:
            out.append((s, v, c))
            last = s + len(v)
    return out


def _find(finder: Finder, kind: str, texts: pa.Array, screens: list[tuple[str, pa.Array]]) -> pa.Array:
    """The spans of one kind.  Texts become Python objects SLICE at a time."""
    script, run = {"full_name": (_LATIN, finder.latin), "non_latin_name": (_ARABIC, finder.arabic)}[kind]
    offsets, starts, names, grades = [0], [], [], []
    for at in range(0, len(texts), SLICE):
        flags = [x.slice(at, SLICE).to_pylist() for _, x in screens]
        for text, *seen in zip(texts.slice(at, SLICE).to_pylist(), *flags):
            if text and script.search(text):
                for s, m, c in run(text, frozenset(name for (name, _), yes in zip(screens, seen) if not yes)):
                    starts.append(s)
                    names.append(m)
                    grades.append(c)
            offsets.append(len(starts))
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(names, pa.string()), pa.array(grades, pa.string())], ["s", "m", "confidence"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def spans_of(text: Column, lexicon: Lexicon | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    """A struct of arrays of spans, one of each kind.  Texts without a letter of a kind's script stay in the JVM.

    Declared not deterministic, so that a condition on what it finds does not run it twice.
    """
    lexicon = lexicon or Lexicon()

    def find(texts: pa.Array) -> pa.Array:
        finder = Finder(lexicon)
        screens = [(name, pc.match_substring_regex(texts, rx)) for name, rx in finder.screens.items() if "full_name" in kinds or name == "fields"]
        return pa.StructArray.from_arrays([_find(finder, k, texts, screens) for k in kinds], list(kinds))

    letters = r"\p{L}" if "full_name" in kinds else _ARABIC.pattern
    udf = F.arrow_udf(find, f"struct<{', '.join(f'{k}:{NAME_SPANS}' for k in kinds)}>").asNondeterministic()
    return udf(F.when(text.rlike(letters), text))
