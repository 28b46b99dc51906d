"""Problem 9: personal information inside free text.

Mail addresses, phone numbers, identity numbers, street addresses and names are found by their forms and the words around
them and replaced by typed placeholders with a pseudonym. The pseudonym of a number keeps its format, separators included: a
keyed Feistel network permutes its digits (and another one its letters), so equal values have equal pseudonyms in every
document and different values of one format different ones; with the key it can be turned back. Identity numbers are
validated by their check digits and ranges, and the permutation is repeated until a valid number has a valid pseudonym and
an invalid one an invalid one. Given names are learned from the corpus beside the common ones: a first word of names that stand
behind a cue in LEARNED documents or more, and in half of all documents in which a capitalised word follows it; so a name is
found where no cue stands. Dates of birth are permuted among the days of two centuries, in their own format. Names, mail
and street addresses have no format to keep; they get a keyed hash.

The key comes from the caller, from spark.quire.pseudonym.key or from QUIRE_PSEUDONYM_KEY. Without one a random key is drawn
for the run and thrown away: values stay linked within the run, and nobody can turn them back.

Null or empty texts give no row in the findings and stay as they are in the redacted table. Overlapping findings: the one
that is named first in ORDER stays. Rows with an equal doc_id are documents of their own, their findings are taken together.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

FOUND = "doc_id bigint, kind string, value string, pseudonym string, start int, stop int"
ORDER = ("EMAIL", "ID", "PHONE", "ADDRESS", "NAME")
ROUNDS = 8
#: Documents in which a given name has to stand behind a cue, and its share of those in which it opens a capitalised pair; the most
#: names that are sent along with the tasks (the most frequent ones; given names are far fewer in any corpus).
LEARNED, CUED_SHARE, NAMES = 3, 0.5, 100_000
#: Days among which dates of birth are permuted.
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĘĚŁŃŇŐŘŚŞŠŤŮŹŻŽА-ЯЁІ"
LOW = "a-zß-öø-ÿāăąćčďęěłńňőřśşšťůźżžа-яёі"
CAP = rf"(?:[DLOdl]['’])?[{UP}][{LOW}]+(?:[-'’][{UP}]?[{LOW}]+)*"
CAPS = rf"[{UP}]{{2,}}(?:[-'’][{UP}]{{2,}})*|[DLO]['’][{UP}]{{2,}}(?:-[{UP}]{{2,}})*"
INI = rf"[{UP}]\."
S = r"[ \t ]*\n?[ \t ]*"  # space or one line break
G = r"[ \t ]+\n?[ \t ]*|\n[ \t]*"

#: Common given names of the four languages (fixed values).
GIVEN = (
    "Adam Adrian Albert Alexander Alfred Alice Amelia Andrew Angela Ann Anna Anne Arthur Barbara Benjamin Bernard Carol Catherine Charles Charlotte Christine Christopher Clara Daniel David Deborah Diana Donald Dorothy Edith Edward Eleanor "
    "Elizabeth Ellen Emily Emma Eric Eva Florence Frances Frank Frederick George Grace Hannah Harold Harry Helen Henry Hugh Ian Irene Jack James Jane Janet Jean Jennifer John Joseph Julia Karen Kenneth Laura Linda Louise Lucy Margaret Maria "
    "Mark Martin Mary Matthew Michael Michelle Nancy Nora Olivia Oscar Oliver Patricia Patrick Paul Peter Philip Rachel Rebecca Richard Robert Rose Ruth Samuel Sarah Sandra Simon Sophie Stephen Susan Theresa Thomas Victor Victoria Walter William "
    "Andreas Anton Bernd Birgit Christian Emil Gustav Matthias Otto Paula Dieter Elke Franz Friedrich Fritz Georg Gerda Greta Günter Hans Heike Heinrich Helga Hermann Holger Ilse Ingrid Johann Jürgen Karl Käthe Klaus Kurt Lena Lotte Monika Petra Rainer Renate Sabine Stefan Ursula Ute Uwe Werner Wolfgang "
    "Agnès Alain Amélie André Antoine Bernadette Brigitte Camille Cécile Chantal Claire Claude Élise Émile Étienne Fabien François Françoise Gérard Gilles Guillaume Hélène Henri Isabelle Jacques Jeanne Jérôme Juliette Laurent Luc Lucie Madeleine Marc Marcel Margot "
    "Marie Mathilde Michel Monique Nathalie Nicolas Noël Odile Olivier Pascal Philippe Pierre Rémi René Simone Solange Sylvie Thérèse Valérie Yves "
    "Александр Алексей Алла Анастасия Анатолий Андрей Анна Антон Борис Вадим Валентина Василий Вера Виктор Владимир Галина Георгий Глеб Григорий Дарья Денис Дмитрий Евгений Егор Екатерина Елена Зинаида Иван Игорь Илья Ирина Кирилл Константин Ксения "
    "Лев Лидия Людмила Максим Мария Марина Михаил Надежда Наталья Николай Нина Олег Ольга Павел Пётр Полина Раиса Роман Светлана Семён Сергей Софья Степан Тамара Татьяна Фёдор Юлия Юрий Яков"
).split()
GIVEN_RE = "|".join(sorted(map(re.escape, {*GIVEN, *(g.upper() for g in GIVEN)}), key=len, reverse=True))
#: Words that make a capitalised pair a firm or a place (fixed values).
NOT_PERSON = frozenset(
    "works werke werk ltd limited gmbh ag kg co company inc corp sarl sas sa ооо оао зао ао завод brothers sons söhne frères group gruppe port north south east west upper lower old new saint "
    "street road lane avenue court drive terrace hill bridge quarry river lake bay canal harbour harbor sheet shaft lot reference straße weg platz allee rue chemin quai улица переулок dear the this that der die das den dem des ein eine einen kein keine unser unsere le la les un une notre leur leurs ces".split()
)

EMAIL = re.compile(
    rf"(?<![\w.+-])(?:mailto:)?[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{S}[\[({{]{S}(?:at|AT|ät|собака){S}[\])}}]{S}|[ \t]?[@＠]{S})(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)(?:\.|{S}[\[({{]{S}(?:dot|DOT|punkt|point|точка){S}[\])}}]{S}))+(?!(?:png|jpe?g|gif|tiff?|svg|webp|pdf|bmp|txt|csv|md|html?|xml|json|py|js|css)\b)[A-Za-z]{{2,24}}(?![\w])(?!\()"
)
EMAIL_HINT = re.compile(r"[@＠]|[\[({]\s*(?:at|AT|ät|собака)\s*[\])}]")

ID_WORDS = (
    r"SSN|social\s+security(?:\s+(?:number|no\.?))?|National\s+Insurance(?:\s+(?:number|no\.?))?|NI(?:NO|\s+number|\s+no\.?)|insurance\s+(?:number|no\.?)|passport(?:\s+(?:number|no\.?))?|identity\s+card(?:\s+(?:number|no\.?))?|ID\s+card(?:\s+(?:number|no\.?))?|"
    r"driv(?:er's|ing)\s+licen[cs]e(?:\s+(?:number|no\.?))?|tax\s+(?:ID|number)|Steuer-?ID|Steuer(?:identifikations)?nummer|(?:Personal)?[Aa]usweis(?:nummer|-?[Nn]r\.?)?|Reisepass(?:nummer|-?[Nn]r\.?)?|(?:Sozial|Renten|Kranken)versicherungs(?:nummer|-?[Nn]r\.?)|Führerschein(?:nummer|-?[Nn]r\.?)?|"
    r"NIR|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|passeport|carte\s+(?:nationale\s+)?d['’]identit[ée]|CNI|permis\s+de\s+conduire|num[ée]ro\s+fiscal|СНИЛС|ИНН|паспорт(?:а|е|у|ом)?|удостоверени[ея]|водительско\w+\s+удостоверени\w+"
)
ID_VALUE = r"[A-ZА-Я]{0,3}[ \n-]?\d(?:[\dA-ZА-Я]|[ \t ]?[-–./]?[ \t \n]?(?=[\dA-Z]*\d|[A-D]\b)[\dA-Z]){4,22}|\d{2}[A-Z]{2}\d{4,6}|[A-Z]{2}-?\d[\d -]{4,14}\d"
ID_CUED = re.compile(rf"(?<![\w])(?:{ID_WORDS})(?:{S}(?:n[°ºo]\.?|№|[Nn]r\.?|no\.?|#|:|серия|номер))*{S}(?P<v>{ID_VALUE})(?![\w])")
ID_BARE = re.compile(r"(?<![\w.-])(?:(?P<v>\d{3}-\d{2}-\d{4})|(?P<w>[A-CEGHJ-PR-TW-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]))(?![\w-])")

_ = r"(?:[ \t .\-–]|[ \t]?\n[ \t]*)"
EXT = rf"(?:{S}(?:ext\.?|x|Durchwahl|poste|доб\.?){S}\d{{1,5}})?"
PHONE = re.compile(
    r"(?<![\w.,$+/@:=\\-])(?:tel:)?(?:"
    rf"\+\d{{1,3}}(?:{_}?\(\d{{1,5}}\))?(?:{_}?\d{{1,8}}){{1,6}}"  # international
    rf"|00[1-9]\d{{0,2}}{_}\(?\d{{1,5}}\)?(?:{_}?\d{{2,8}}){{1,4}}"  # international with 00
    rf"|1?{_}?\(?[2-9]\d{{2}}\)?{_}\d{{3}}{_}\d{{4}}"  # North America
    rf"|\(0\d{{1,5}}\){_}?\d{{3,8}}(?:{_}\d{{2,5}})*|0\d{{1,5}}/{S}\d{{4,9}}(?:{_}\d{{1,4}})?"  # Germany
    rf"|0\d{{2}}{_}\d{{4}}{_}\d{{4}}|0\d{{4}}{_}\d{{5,6}}|0\d{{3}}{_}\d{{3}}{_}\d{{4}}"  # United Kingdom
    rf"|0[1-9](?:{_}\d{{2}}){{4}}|0[1-9]\d{{8}}"  # France
    rf"|[87]{_}?\(\d{{3,5}}\){_}?\d{{1,3}}(?:{_}?\d{{2,4}}){{1,3}}|8{_}\d{{3}}{_}\d{{3}}{_}\d{{2}}{_}\d{{2}}|8-\d{{3}}-\d{{3}}-\d{{2}}-\d{{2}}"  # Russia
    rf"){EXT}(?![\w@])(?![-–/.]\d)"
)
PHONE_CUE = re.compile(r"(?:Call|Phone|Fax|Tel(?:efon)?\.?|Tél\.?|Тел\.?|телефон\w*|reached on|Rückfragen unter|Renseignements au|Mobil|tel:)[:\s]*$", re.I)
PHONE_HINT = re.compile(r"\+\d|\d[\d().\s/–-]{7,}\d")

STREET_EN = r"Street|St\.|Road|Rd\.?|Lane|Avenue|Ave\.?|Court|Drive|Terrace|Close|Crescent|Square|Gardens|Row|Mews|Boulevard|Place|Walk|Way|Hill"
WORDS_EN = rf"(?:(?:St|Saint|{CAP}|[A-Z]['’]?[A-Z]+)(?:['’][sS])?(?:{G})){{1,3}}"
TOWN = rf"(?:,?(?:{G})(?:{CAP}|[{UP}]{{3,}})(?:(?:{G}|-)(?:{CAP}|[{UP}]{{3,}})){{0,2}})"
POSTCODE = rf"(?:,?(?:{G})[A-Z]{{1,2}}\d{{1,2}}[A-Z]?(?:{G})\d[A-Z]{{2}})"
ADDRESS = [
    re.compile(rf"(?<![\w.])(?:(?:Flat|Apt\.?|Unit|Suite|FLAT)(?:{G})\d+[A-Za-z]?,?(?:{G}))?\d{{1,4}}[A-Za-z]?(?:{G}){WORDS_EN}(?:{STREET_EN}|{STREET_EN.upper()})(?!\w)(?:{TOWN}(?=[\s.,;]|$))?{POSTCODE}?"),
    re.compile(rf"(?<!\w){WORDS_EN}(?:{STREET_EN}|{STREET_EN.upper()})(?:{G})(?:No\.?|NO\.?|Nr\.?)(?:{G})\d+[A-Za-z]?(?:{TOWN})?{POSTCODE}?"),
    re.compile(rf"(?<!\w)(?:{CAP}-?)?(?:[{UP}]?[{LOW}]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|stieg)|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den)(?:{G}){CAP}(?:(?:{G}){CAP})?)(?:{G})\d{{1,4}}(?:[ ]?[a-z])?(?:,?(?:{G})(?:[A-Z]-)?\d{{5}}(?:{G}){CAP}(?:-{CAP})?|,(?:{G}){CAP})"),
    re.compile(rf"(?<![\w.])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-Z])(?!\w))?,?(?:{G})(?:rue|avenue|av\.|boulevard|bd|chemin|impasse|place|quai|allée|allee|route|cours|passage|sentier|square|venelle)(?:{G})(?:(?:de(?:{G})la|des|du|de|d['’]|l['’])(?:{G})?)*(?:l['’])?{CAP}(?:(?:{G}|-){CAP}){{0,3}}(?:,?(?:{G})(?:\d{{5}}(?:{G}))?{CAP}(?:-(?:le|la|les|sur|en|de)?-?{CAP})*)?"),
    re.compile(rf"(?<!\w)(?:г\.{S}{CAP},{S})?(?:ул\.|улица|пер\.|переулок|просп\.|пр-т|проспект|наб\.|набережная|шоссе|бульвар|б-р|пл\.|площадь|проезд){S}{CAP}(?:(?:{G}){CAP})?,?{S}(?:д(?:ом)?\.?{S})?\d{{1,4}}[а-я]?(?:,{S}(?:стр|корп|к|кв|оф)\.{S}\d+)*"),
    re.compile(rf"(?<!\w)(?:г\.{S}{CAP},{S})?{CAP}(?:{G})(?:улица|ул\.|переулок|пер\.|проспект|набережная|шоссе|бульвар|площадь|проезд),?{S}(?:д(?:ом)?\.?{S})?\d{{1,4}}[а-я]?(?:,{S}(?:стр|корп|к|кв|оф)\.{S}\d+)*"),
]
PERSON = rf"(?:{CAPS}),{S}(?:{CAP}|{INI})|(?:{INI}{S}){{1,2}}(?:{CAP}|{CAPS})|(?:{CAP}|{CAPS})(?:{G})(?:{INI}{S})?(?:{CAP}|{CAPS})|(?:{CAP}|{CAPS})(?:{G}){INI}(?:{S}{INI})?|{CAP},(?:{G}){CAP}"
CUES = (
    r"signed by|[Pp]repared by:?|[Ww]ritten by:?|[Cc]hecked by:?|[Aa]pproved by:?|[Dd]rawn by:?|[Rr]ecorded by:?|[Rr]eturn(?:ed)?(?:\s+the\s+\w+)?\s+to|[Cc]ontact person:?|[Aa]ttn\.?:?|cc|Name:|"
    r"Protokoll führte|Bearbeiter(?:in)?:|gez\.|[Gg]ezeichnet:?|Unterschrift:|Verfasser(?:in)?:|Ansprechpartner(?:in)?:|z\.\s?Hd\.|[Ee]rstellt von:?|[Gg]eprüft von:?|[Uu]nterzeichnet von|Herrn?|Frau|"
    r"signé(?:e|s)? par|[Rr]édigé par\s?:?|[Vv]u et approuvé,|[Vv]érifié par\s?:?|[Ét]tabli par\s?:?|à l['’]attention de|Monsieur|Madame|Mme|Mlle|"
    r"[Сс]оставила?:|[Пп]ротокол вела?|[Пп]ротокол вёл|[Пп]роводит инженер|[Пп]одписала?:?|[Уу]твердила?:?|[Ии]сполнитель:|[Пп]роверила?:|господин|г-н|г-жа|"
    r"Dr\.?|Prof\.?|Mr\.?|Mrs\.?|Ms\.?"
)
NAME_CUED = re.compile(rf"(?<![\w.])(?:{CUES}){S}(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?{S})?(?P<v>{PERSON})(?!\w)")
NAME_GIVEN = re.compile(
    rf"(?<![\w.-])(?P<v>(?:{GIVEN_RE})(?:{G})(?:{INI}{S})?(?:{CAP}|{CAPS})|(?:{CAPS}),{S}(?:{GIVEN_RE}))(?!\w)"
)

#: A form of address before a single name.
NAME_TITLED = re.compile(rf"(?<![\w.])(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|господин|госпожа|г-н|г-жа)(?:{G})(?P<v>(?:{CAP}|{CAPS}))(?!\w)")
BORN = re.compile(r"(?:\b(?:born(?:\s+on)?|date\s+of\s+birth|DOB|geb(?:oren)?\.?(?:\s+am)?|Geburtsdatum|née?\s+le|date\s+de\s+naissance|родил(?:ся|ась)|дата\s+рождения)|д\.\s?р\.)[\s:]*(?P<v>\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)", re.I)


def is_person(value: str) -> bool:
    words = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", value)
    return not any(w.lower() in NOT_PERSON for w in words) and any(len(w) > 2 for w in words)


#: A capitalised word before another one; the words that open a sentence as often as a name are told apart by their counts.
NAME_PAIR = re.compile(rf"(?<![\w.-])(?P<v>(?P<g>[{UP}][{LOW}]{{2,}}(?:-[{UP}][{LOW}]+)?)(?:[ \t]+\n?[ \t]*|\n[ \t]*)(?:{INI}{S})?(?:{CAP}|{CAPS}))(?!\w)")

FIRST_OF_PAIR = re.compile(rf"(?<![\w.-])([{UP}][{LOW}]{{2,}}(?:-[{UP}][{LOW}]+)?)(?=(?:[ \t]+\n?[ \t]*|\n[ \t]*)(?:{INI}{S})?(?:{CAP}|{CAPS})(?!\w))")


def is_phone(value: str, before: str) -> bool:
    digits = re.sub(r"\D", "", re.sub(r"(?:ext|x|доб|poste|Durchwahl).*", "", value))
    if not 7 <= len(digits) <= 15 or re.fullmatch(r"\d{4}[-.]\d\d[-.]\d\d", value.strip()):
        return False
    if value.lstrip().startswith(("+", "tel:", "(", "00")) or PHONE_CUE.search(before):
        return len(digits) >= 7
    # a code before it, as of drawings and lots, makes it a part of the code
    return not re.search(r"(?:\b[A-ZА-Я]{1,4}\d*|lot|vol\.|No\.|№|Nr\.|§)[ \t-]*$", before) and len(digits) >= 10


#: Literals that have to stand near a finding of a kind (fixed values); they are looked for in one pass over the text.
NEAR = {
    "ID": "SSN|ocial security|ational Insurance|NINO|NI number|NI no|nsurance n|assport|dentity card|ID card|river's lic|riving lic|tax ID|tax number|Steuer|usweis|Reisepass|versicherungs|Führerschein|NIR|curité soc|curite soc|passeport|identité|CNI|de conduire|fiscal|СНИЛС|ИНН|паспорт|достоверени",
    "CUE": "signed by|repared by|ritten by|hecked by|pproved by|rawn by|ecorded by|eturn the|eturned to|eturn to|ontact person|ttn:|ttn.|cc |Name:|rotokoll f|Bearbeiter:|Bearbeiterin:|gez.|ezeichnet von|ezeichnet:|terschrift:|erfasser:|erfasserin:|nsprechpartner|z. Hd|rstellt von|eprüft von|rzeichnet von|Herr |Herrn |Frau |signé par|signée par|signés par|édigé par|et approuvé|érifié par|tabli par|ttention de|Monsieur|Madame|Mme|Mlle|оставил:|оставила:|ротокол в|роводит инж|одписал|твердил|сполнитель:|роверил|господин|г-н|г-жа|Dr |Dr.|Prof|Mr |Mr.|Mrs|Ms |Ms.",
    "VERB": " kept| checked| signed| wrote| approved| prepared| recorded| drew| at the front desk|, site office| bewahrte| prüfte die Z| führte| unterschrieb| unterzeichnete| a conservé| a signé| a vérifié| a rédigé| a approuvé| хранит| проверил| подписал| вёл| ведёт| составил| утвердил",
    "STREET": "Street|Road|Lane|Avenue|Court|Drive|Terrace|Close|Crescent|Square|Gardens|Row|Mews|Boulevard|Place|Walk| Way|Hill|St. | Rd|Ave|STREET|ROAD|LANE|AVENUE|COURT|DRIVE|TERRACE|CLOSE|CRESCENT|SQUARE|GARDENS|MEWS|BOULEVARD| PLACE| WALK| WAY| HILL",
    "STRASSE": "straße |strasse |str. |weg |gasse |platz |allee |ring |ufer |damm |steig |stieg ",
    "RUE": "rue |avenue |av. |boulevard |bd |chemin |impasse |place |quai |allée |allee |route |cours |passage |sentier |square |venelle ",
    "УЛИЦА": "ул.|улица|пер.|переулок|просп|пр-т|наб.|набережная|шоссе|бульвар|б-р|пл.|площадь|проезд",
}
WINDOW = 110
ZIP = re.compile(rf"\d[ ]?[a-z]?,?\s+(?:[A-Z]-)?\d{{5}}\s[{UP}]")
NI = re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]")
PERSON_BEFORE = re.compile(rf"(?<![\w.-])(?P<v>{PERSON})\s*$")
NUMBER_AFTER = re.compile(r"\s*(?:No\.?\s*|NO\.?\s*|Nr\.?\s*)?\d")


class Literals:
    """One automaton of all literals and given names, the learned ones among them."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.learned = learned
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for kind, words in NEAR.items():
            for w in words.split("|"):
                by.setdefault(w, []).append(kind)
        for g in {*GIVEN, *(g.upper() for g in GIVEN)}:
            by.setdefault(g, []).append("GIVEN")
        for g in learned:
            by.setdefault(g, []).append("LEARNED")
        for w, kinds in by.items():
            self.automaton.add_word(w, (len(w), tuple(kinds)))
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """(start, end) of the literals of each kind."""
        out: dict[str, list[tuple[int, int]]] = {}
        for end, (n, kinds) in self.automaton.iter(text):
            for kind in kinds:
                out.setdefault(kind, []).append((end + 1 - n, end + 1))
        return out


def windows(places: list[tuple[int, int]], n: int, reach: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of the text around the places, merged where they meet."""
    out: list[list[int]] = []
    for a, b in places:
        a, b = max(0, a - reach), min(n, b + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str, literals: Literals) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data, without overlaps, in the order of the text."""
    out: list[tuple[int, int, str]] = []
    near = literals.places(text.replace("\n", " "))
    n = len(text)

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y, _ in out)

    def take(rule: re.Pattern, kind: str, group: str | int, areas: list[tuple[int, int]], right=None) -> None:
        for a, b in areas:
            for m in rule.finditer(text, a, b):
                if free(*m.span(group)) and (right is None or right(m)):
                    out.append((*m.span(group), kind))

    whole = [(0, n)]
    if "@" in text or "＠" in text or EMAIL_HINT.search(text):
        take(EMAIL, "EMAIL", 0, whole)
    if "ID" in near:
        take(ID_CUED, "ID", "v", windows(near["ID"], n))
    numbers = PHONE_HINT.search(text)
    if numbers or NI.search(text):
        take(ID_BARE, "ID", 0, whole)
    if numbers:
        take(PHONE, "PHONE", 0, whole, lambda m: is_phone(m.group(), text[max(0, m.start() - 24) : m.start()]))
    if "STREET" in near:
        for rule in ADDRESS[:2]:
            take(rule, "ADDRESS", 0, windows(near["STREET"], n))
    german = [p for p in near.get("STRASSE", ()) if text[p[1] : p[1] + 1].isdigit()] + [m.span() for m in ZIP.finditer(text)]
    if german:
        take(ADDRESS[2], "ADDRESS", 0, windows(sorted(german), n))
    french = [p for p in near.get("RUE", ()) if any(c.isdigit() for c in text[max(0, p[0] - 12) : p[0]])]
    if french:
        take(ADDRESS[3], "ADDRESS", 0, windows(french, n))
    if "УЛИЦА" in near:
        for rule in ADDRESS[4:]:
            take(rule, "ADDRESS", 0, windows(near["УЛИЦА"], n))
    person = lambda m: is_person(m["v"])
    if "CUE" in near:
        take(NAME_CUED, "NAME", "v", windows(near["CUE"], n, 70), person)
    for at, _end in near.get("VERB", ()):
        if text[at - 1 : at].isalpha() or text[at - 1 : at] == ".":
            if (m := PERSON_BEFORE.search(text, max(0, at - 60), at)) and free(*m.span("v")) and is_person(m["v"]):
                out.append((*m.span("v"), "NAME"))
    if "CUE" in near:
        take(NAME_TITLED, "NAME", "v", windows(near["CUE"], n, 70), lambda m: is_person(m["v"]) and len(m["v"]) > 2)
    given = [p for p in near.get("GIVEN", ()) if not text[p[0] - 1 : p[0]].isalpha() and not text[p[1] : p[1] + 1].isalpha()]
    if given:
        take(NAME_GIVEN, "NAME", "v", windows(given, n, 50), person)
    learned = [p for p in near.get("LEARNED", ()) if not text[p[0] - 1 : p[0]].isalpha() and not text[p[1] : p[1] + 1].isalpha()]
    for at, _end in learned:
        m = NAME_PAIR.match(text, at)
        if m and m["g"] in literals.learned and is_person(m["v"]) and free(*m.span("v")):
            out.append((*m.span("v"), "NAME"))
    if "0" in text or "1" in text:
        take(BORN, "DATE", "v", whole, lambda m: day_of(m["v"]) is not None)
    return sorted(out)


DAY = (re.compile(r"(?P<d>\d{1,2})(?P<s>[./])(?P<m>\d{1,2})[./](?P<y>\d{4})"), re.compile(r"(?P<y>\d{4})(?P<s>-)(?P<m>\d{2})-(?P<d>\d{2})"))


def day_of(value: str) -> int | None:
    """The number of the day that a date of one of the two formats names; None if there is no such day between FIRST and LAST."""
    for rule in DAY:
        if m := rule.fullmatch(value):
            try:
                day = date(int(m["y"]), int(m["m"]), int(m["d"])).toordinal()
            except ValueError:
                return None
            return day if FIRST <= day <= LAST else None
    return None


class Feistel:
    """Keyed permutation of the strings of one length over one alphabet, by an unbalanced Feistel network."""

    def __init__(self, key: str):
        self.key = key.encode()

    def _round(self, i: int, tweak: str, half: str, size: int) -> int:
        mac = hmac.new(self.key, f"{i}|{tweak}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(mac[:16], "big") % size

    def permute(self, text: str, alphabet: str, back: bool = False) -> str:
        base, n = len(alphabet), len(text)
        if not n:
            return text
        where = {c: i for i, c in enumerate(alphabet)}
        if n == 1:  # a keyed rotation
            k = self._round(0, alphabet[0] + "1", "", base)
            return alphabet[(where[text] + (-k if back else k)) % base]
        u, v = n // 2, n - n // 2

        def number(s: str) -> int:
            x = 0
            for c in s:
                x = x * base + where[c]
            return x

        def string(x: int, k: int) -> str:
            out = []
            for _ in range(k):
                x, r = divmod(x, base)
                out.append(alphabet[r])
            return "".join(reversed(out))

        a, b = text[:u], text[u:]
        tweak = f"{alphabet[0]}{n}"
        # even rounds change a by b, odd ones b by a; the lengths stay
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                a = string((number(a) + sign * self._round(i, tweak, b, base**u)) % base**u, u)
            else:
                b = string((number(b) + sign * self._round(i, tweak, a, base**v)) % base**v, v)
        return a + b

    def value(self, text: str, back: bool = False) -> str:
        """Digits for digits and ASCII letters for letters; separators stay."""
        for alphabet, rule in (("0123456789", r"[0-9]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[A-Z]"), ("abcdefghijklmnopqrstuvwxyz", r"[a-z]")):
            chars = re.findall(rule, text)
            if chars:
                new = iter(self.permute("".join(chars), alphabet, back))
                text = re.sub(rule, lambda m: next(new), text)
        return text


def mod_11_10(digits: str) -> bool:
    """ISO 7064 with a check digit at the end, as German tax numbers have it."""
    p = 10
    for c in digits[:-1]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def weighted(digits: str, weights: list[int], modulus: int) -> int:
    return sum(int(c) * w for c, w in zip(digits, weights)) % modulus


#: Weights of the check digits of Russian tax numbers (fixed values).
TAX_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
TAX_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
TAX_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


def valid(value: str) -> str:
    """The scheme whose rules an identity number keeps; nothing if there is none."""
    plain = re.sub(r"[^0-9A-Za-z]", "", value).upper()
    n = len(plain)
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", plain):
        return "insurance" if not re.match(r"[DFIQUV]|.[DFIQUVO]|BG|GB|KN|NK|NT|TN|ZZ", plain) else ""
    if not plain.isdigit():
        return ""
    if n == 9:
        return "security" if plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000" else ""
    if n == 10:
        return "tax" if weighted(plain, TAX_10, 11) % 10 == int(plain[9]) else ""
    if n == 11:
        if plain[0] != "0" and mod_11_10(plain):
            return "tax"
        return "pension" if weighted(plain, list(range(9, 0, -1)), 101) % 100 == int(plain[9:]) else ""
    if n == 12:
        return "tax" if weighted(plain, TAX_11, 11) % 10 == int(plain[10]) and weighted(plain, TAX_12, 11) % 10 == int(plain[11]) else ""
    if n == 15:
        return "registry" if 97 - int(plain[:13]) % 97 == int(plain[13:]) else ""
    return ""


def normal(kind: str, value: str) -> str:
    """One spelling of equal values, separators kept where the pseudonym keeps them."""
    value = re.sub(r"\s+", " ", value.strip())
    if kind == "EMAIL":
        value = re.sub(r"^mailto:", "", value.lower().replace("＠", "@"))
        value = re.sub(r"\s*[\[({]\s*(?:at|ät|собака)\s*[\])}]\s*", "@", value)
        return re.sub(r"\s*[\[({]\s*(?:dot|punkt|point|точка)\s*[\])}]\s*", ".", value)
    if kind == "PHONE":
        return re.sub(r"^00(?=[1-9])", "+", re.sub(r"^tel:", "", value))
    return value if kind in ("ID", "DATE") else value.casefold()


def same_kind(feistel: Feistel, value: str, back: bool = False) -> str:
    """The permuted identity number, valid by the same rules as the number itself, or by none as it is."""
    rules = valid(value)
    out = feistel.value(value, back)
    while valid(out) != rules:
        out = feistel.value(out, back)
    return out


def moved_day(feistel: Feistel, value: str, back: bool = False) -> str:
    day = day_of(value)
    rule = next(r for r in DAY if r.fullmatch(value))
    m = rule.fullmatch(value)
    out = f"{day - FIRST:05d}"
    out = feistel.permute(out, "0123456789", back)
    while int(out) > LAST - FIRST:
        out = feistel.permute(out, "0123456789", back)
    new = date.fromordinal(FIRST + int(out))
    if m["s"] == "-":
        return new.isoformat()
    return f"{new.day:02d}{m['s']}{new.month:02d}{m['s']}{new.year}"


def pseudonym(kind: str, value: str, feistel: Feistel, back: bool = False) -> str:
    """What stands for a value; back=True turns the pseudonym of a number or date into the value again."""
    plain = normal(kind, value)
    if kind == "PHONE":
        # the number and its extension are permuted apart, so numbers stay linked whatever the extension
        m = re.match(r"(.*?)(\s*(?:ext\.?|x|Durchwahl|poste|доб\.?)\s*\d+)?$", plain, re.S)
        return feistel.value(m[1], back) + (feistel.value(re.sub(r"\D", "", m[2]), back).join(re.split(r"\d+", m[2], maxsplit=1)) if m[2] else "")
    if kind == "ID":
        return same_kind(feistel, plain, back)
    if kind == "DATE":
        return moved_day(feistel, plain, back)
    return hmac.new(feistel.key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:16]


def key_of(spark: SparkSession, key: str | None = None) -> str:
    return key or spark.conf.get("spark.quire.pseudonym.key", None) or os.environ.get("QUIRE_PSEUDONYM_KEY") or secrets.token_hex(32)


def given_names(documents: DataFrame, least: int = LEARNED, share: float = CUED_SHARE) -> DataFrame:
    """(name, cued, pairs): first words of capitalised pairs (documents: text) that are given names by where they stand: behind a
    cue in `least` documents or more, and in a `share` of the documents in which they open a pair. Each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literals = Literals()
        cued: Counter = Counter()
        pairs: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                near = literals.places(text.replace("\n", " "))
                behind = set()
                for a, b in windows(near.get("CUE", ()), len(text), 70):
                    for m in NAME_CUED.finditer(text, a, b):
                        if (g := NAME_PAIR.fullmatch(m["v"])) and is_person(m["v"]):
                            behind.add(g["g"])
                cued.update(behind)
                pairs.update(set(FIRST_OF_PAIR.findall(text)))
            if len(pairs) > 500_000:
                yield counts(cued, pairs)
        yield counts(cued, pairs)

    def counts(cued: Counter, pairs: Counter) -> pa.RecordBatch:
        names = list(pairs | cued)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([cued[n] for n in names], pa.int64()), pa.array([pairs[n] for n in names], pa.int64())], names=["name", "cued", "pairs"])
        cued.clear()
        pairs.clear()
        return out

    texts = documents.select("text").where("text is not null and text <> ''")
    counted = texts.mapInArrow(run, "name string, cued bigint, pairs bigint").groupBy("name").agg(F.sum("cued").alias("cued"), F.sum("pairs").alias("pairs"))
    return counted.where((F.col("cued") >= least) & (F.col("cued") >= share * F.col("pairs")))


def learned_names(documents: DataFrame) -> frozenset[str]:
    names = given_names(documents).orderBy(F.desc("cued"), "name").limit(NAMES)
    return frozenset(r["name"] for r in names.select("name").toLocalIterator()) - {*GIVEN}


def personal_data(documents: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, kind, value, pseudonym, start, stop) of all personal data of documents (doc_id, text)."""
    key = key_of(documents.sparkSession, key)
    learned = learned_names(documents)

    def run(doc, text, feistel, literals):
        for a, b, kind in spans(text, literals):
            yield doc, kind, text[a:b], pseudonym(kind, text[a:b], feistel), a, b

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    return C.arrow_rows(docs, run, FOUND, lambda: (Feistel(key), Literals(learned)))


def redacted(documents: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_replaced): every text with typed placeholders [KIND:pseudonym]."""
    key = key_of(documents.sparkSession, key)
    learned = learned_names(documents)

    def run(doc, text, feistel, literals):
        if not text:
            yield doc, text, 0
            return
        out, at = [], 0
        found_spans = spans(text, literals)
        for a, b, kind in found_spans:
            out += [text[at:a], f"[{kind}:{pseudonym(kind, text[a:b], feistel)}]"]
            at = b
        yield doc, "".join(out) + text[at:], len(found_spans)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return C.arrow_rows(docs, run, "doc_id bigint, text string, n_replaced int", lambda: (Feistel(key), Literals(learned)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(C.table(spark, sf_dir, "documents")).drop("value")


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(C.table(spark, sf_dir, "documents"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind); dates of birth are replaced, but are no kind asked for."""
    return personal_data(C.table(spark, sf_dir, "documents")).where(F.col("kind").isin(*ORDER)).select("doc_id", "kind").distinct()
