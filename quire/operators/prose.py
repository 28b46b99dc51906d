"""Running text of a body: furniture of pages, spaced letters, split numbers, crushed paragraphs, emphasis, compounds, spellings."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from statistics import median

Segments = list[list]

WORD = re.compile(r"[^\W\d_]+")
STRUCTURE = re.compile(r"^\s*(?:#{1,6}\s|[-*+]\s|\d{1,9}[.)]\s|>|<|\||!\[|```|~~~|\$\$)")
MARK = re.compile(r"^<!-- source:page \d+ -->$")
CAPTION = re.compile(r"\b(?:fig(?:ure)?|table|abb(?:ildung)?|tabelle|tableau|рис(?:унок)?|таблица)\b", re.I)
ROMAN = re.compile(r"^(?=[IVXLCDM])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")
ASIDE = re.compile(r"`[^`\n]*`|\$[^$\n]*\$|\]\([^()\s]*\)|https?://\S+|(?<!\S)[^\s@]+@\S+")
STOP = re.compile(r"[.!?;:…]$")


def words_of(segs: Segments) -> Counter:
    text = "\n".join(x for x, p in segs if not p and not x.startswith("<!--"))
    return Counter(WORD.findall(ASIDE.sub(" ", text).casefold()))


def roman_joined(line: str) -> str:
    """`V II.11` reads VII.11 if the joined numeral is one."""
    return re.sub(r"\b([IVXLCDM]+) ([IVXLCDM]+)(?=\.\d)", lambda m: m[1] + m[2] if ROMAN.match(m[1] + m[2]) else m.group(), line)


def decimals_joined(line: str) -> str:
    """`36. 90` reads 36.90 where something says that it is one number: its cell, groups of thousands before it, a per cent sign."""
    line = re.sub(r"(?<=\|)(\s*\d+)\. (\d+)(?=\s*\|)", r"\1.\2", line)
    line = re.sub(r"(?<![\d.,])(\d{1,3}(?: \d{3})+)\. (\d+)(?![\d.])", r"\1.\2", line)
    return re.sub(r"(?<![\d.,])(\d+)\. (\d+)(?=\s*%)", r"\1.\2", line)


def furniture(segs: Segments, longest: int = 80, pairs: int = 4, share: float = 0.5, letters: int = 24, apart: int = 20) -> set[int]:
    """Places of running titles that come back beside a numbered neighbour, and of these neighbours."""
    titles: dict[str, list[int]] = defaultdict(list)
    filled = [i for i, (x, p) in enumerate(segs) if not p and x.strip() and not MARK.match(x)]
    order = {i: k for k, i in enumerate(filled)}
    for i in filled:
        x = segs[i][0].strip()
        if len(x) <= longest and len(x.split()) >= 2 and not x[0].islower() and not STOP.search(x) and not STRUCTURE.match(x) and "$" not in x and "|" not in x:
            titles[x].append(i)
    gone: set[int] = set()
    for copies in titles.values():
        if len(copies) < pairs:
            continue
        best: list[tuple[int, int]] = []
        for side in (-1, 1):
            near = []
            for i in copies:
                k = order[i] + side
                if 0 <= k < len(filled):
                    y = segs[filled[k]][0].strip()
                    if re.search(r"\d", y) and not STOP.search(y) and not CAPTION.search(y) and sum(c.isalpha() for c in y) <= letters and not STRUCTURE.match(y):
                        near.append((i, filled[k], y))
            groups: dict[str, list] = defaultdict(list)
            for i, j, y in near:
                groups["".join(c for c in y if c.isalpha()).casefold()].append((i, j, y))
            for those in groups.values():
                once = Counter(y.casefold() for _, _, y in those)
                own = [(i, j) for i, j, y in those if once[y.casefold()] == 1]
                best = max(best, own, key=len)
        places = [i for i, _ in best]
        if len(best) >= pairs and len(best) >= share * len(copies) and median(b - a for a, b in zip(places, places[1:])) >= apart:
            gone.update(k for pair in best for k in pair)
    return gone


def without_furniture(segs: Segments) -> Segments:
    gone = furniture(segs)
    return [s for i, s in enumerate(segs) if i not in gone] if gone else segs


def word_pattern(records: list[str]) -> re.Pattern:
    """One pattern of words: `word` stands for itself, `word*` for all that begins with it, `word.` for it and a full stop."""
    parts = [re.escape(r[:-1]) + r"\w*" if r.endswith("*") else re.escape(r[:-1]) + r"\." if r.endswith(".") else re.escape(r) + r"\b" for r in sorted(filter(None, records), key=len, reverse=True)]
    return re.compile(rf"(?<!\w)(?:{'|'.join(parts)})", re.I) if parts else re.compile(r"(?!)")


NOTE = re.compile(r"^\s*\[?(?:image|picture|figure|photo|diagram|bild|abbildung|image|изображение|рисунок)\s*(?:[:—–-].*)?\]?\s*$", re.I)
REFERENCE = re.compile(r"^ {0,3}\[([^\]\n]+)\]:\s*\S+.*$")


def fabrications_dropped(segs: Segments) -> Segments:
    """What a language model puts into a transcript by itself: links to pictures go, links to addresses leave their text, notes in
    place of pictures go unless they repeat a caption, and so do reference definitions that nothing refers to."""
    captions = {" ".join(WORD.findall(x.casefold())) for x, p in segs if not p and CAPTION.match(x.strip())}
    used = {m.casefold() for x, p in segs if not p and not REFERENCE.match(x) for m in re.findall(r"\[([^\]\n]+)\](?!\()", x)}
    out = []
    for line, protected in segs:
        if not protected:
            if NOTE.match(line) and line.strip().startswith("[") and not any(c and c in " ".join(WORD.findall(line.casefold())) for c in captions):
                continue
            if (m := REFERENCE.match(line)) and m[1].casefold() not in used:
                continue
            new = re.sub(r"(?<!!)\[([^\]\n]+)\]\((?:https?:|www\.)[^()\s]*\)", r"\1", re.sub(r"!\[[^\]\n]*\]\([^()\s]*\)", "", line))
            if line.strip() and not new.strip():
                continue
            line = new
        out.append([line, protected])
    return out


SENTENCES = re.compile(r"[.!?…](?:\s|$)")


def emphasis_dropped(segs: Segments, chars: int = 120, sentences: int = 2, coverage: float = 0.9, island: int = 32) -> Segments:
    """A long paragraph that is bold nearly as a whole loses its signs."""
    out = []
    for line, protected in segs:
        if not protected and len(line) >= chars and not STRUCTURE.match(line) and line.count("**") >= 2 and line.count("**") % 2 == 0:
            parts = line.split("**")
            plain = [x.strip() for x in parts[::2]]
            inner = sum(map(len, parts[1::2]))
            if inner >= coverage * len("".join(parts)) and max(map(len, plain)) <= island and len(SENTENCES.findall("".join(parts))) >= sentences:
                line = "".join(parts)
        out.append([line, protected])
    return out


def crushed_runs(segs: Segments, longest: int = 200, least: int = 6) -> list[list[int]]:
    """Places of the lines of runs of short paragraphs of one line each, one of which at least goes on in the next."""
    runs: list[list[int]] = [[]]
    k = 0
    while k < len(segs):
        line, protected = segs[k]
        if protected:
            runs.append([])
        elif line.strip() and not MARK.match(line):
            alone = (k == 0 or segs[k - 1][1] or not segs[k - 1][0].strip()) and (k + 1 == len(segs) or segs[k + 1][1] or not segs[k + 1][0].strip())
            if alone and len(line) <= longest and not STRUCTURE.match(line):
                runs[-1].append(k)
            else:
                runs.append([])
        k += 1
    return [r for r in runs if len(r) >= least and any(goes_on(segs[a][0], segs[b][0]) for a, b in zip(r, r[1:]))]


def goes_on(a: str, b: str) -> bool:
    return not STOP.search(a.strip()) and b.strip()[:1].islower()


def crushed_joined(segs: Segments) -> Segments:
    gone = set()
    for run in crushed_runs(segs):
        head = run[0]
        for a, b in zip(run, run[1:]):
            if goes_on(segs[head][0], segs[b][0]):
                segs[head] = [f"{segs[head][0].rstrip()} {segs[b][0].strip()}", False]
                gone.update(range(a + 1, b + 1))
            else:
                head = b
    return [s for i, s in enumerate(segs) if i not in gone]


SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?: [^\W\d_]){2,}(?![^\W\d_])")


def spaced_joined(segs: Segments, least: int = 2) -> Segments:
    """`i m p o r t a n t` is one word if the body has it elsewhere."""
    if not any(not p and SPACED.search(x) for x, p in segs):
        return segs
    counts = words_of(segs)

    def fix(m: re.Match) -> str:
        word = m.group().replace(" ", "")
        return word if counts[word.casefold()] >= least else m.group()

    return [[x if p or "$" in x or "`" in x else SPACED.sub(fix, x), p] for x, p in segs]


COMPOUND = re.compile(r"(?<![\w-])([^\W\d_]+)-([^\W\d_]+)(?![\w-])")


def compounds_settled(segs: Segments, ratio: int = 3) -> Segments:
    """A word written with and without a hyphen is written the way that is `ratio` times as frequent; several breaks of one are left."""
    if not any(not p and "-" in x and COMPOUND.search(x) for x, p in segs):
        return segs
    counts = words_of(segs)
    broken = Counter(m.group().casefold() for x, p in segs if not p for m in COMPOUND.finditer(x))
    forms: dict[str, set] = defaultdict(set)
    for form in broken:
        forms[form.replace("-", "")].add(form)
    join = {f: f.replace("-", "") for f in broken if len(forms[f.replace("-", "")]) == 1 and counts[f.replace("-", "")] >= ratio * broken[f]}
    split = {j: f for j, those in forms.items() if len(those) == 1 and 0 < counts[j] and broken[f := next(iter(those))] >= ratio * counts[j]}
    if not join and not split:
        return segs

    def drop(m: re.Match) -> str:
        return m[1] + m[2] if m.group().casefold() in join else m.group()

    def restore(m: re.Match) -> str:
        f = split.get(m.group().casefold())
        return m.group()[: f.index("-")] + "-" + m.group()[f.index("-") :] if f else m.group()

    return [[x if p or "](" in x or "`" in x or "$" in x or "://" in x else WORD.sub(restore, COMPOUND.sub(drop, x)), p] for x, p in segs]


def like_case(word: str, token: str) -> str:
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() else word


def tokens_repaired(segs: Segments, witness: int = 20, shortest: int = 6) -> Segments:
    """A word met once that is one letter off exactly one word met `witness` times is that word; a code gets back its capitals."""
    counts = words_of(segs)
    often = [w for w, n in counts.items() if n >= witness and len(w) >= shortest]
    keys: dict[str, set] = defaultdict(set)
    for w in often:
        for k in range(len(w)):
            keys[w[:k] + "*" + w[k + 1 :]].add(w)
    fix = {}
    for w, n in counts.items():
        if n == 1 and len(w) >= shortest:
            near = set().union(*(keys.get(w[:k] + "*" + w[k + 1 :], ()) for k in range(len(w)))) if keys else set()
            if len(near) == 1:
                fix[w] = near.pop()
    codes: dict[str, Counter] = defaultdict(Counter)
    for x, p in segs:
        if not p:
            for c in re.findall(r"\b(?=\w*[^\W\d_]\w*[^\W\d_])(?=\w*\d)[^\W_]+\b", x):
                codes[c.upper()][c] += 1
    cased = {c: up for up, have in codes.items() for c in have if c != up and have[up] >= witness and have[up] > have[c]}
    if not fix and not cased:
        return segs

    def one(line: str) -> str:
        if cased:
            line = re.sub(r"\b[^\W_]+\b", lambda m: cased.get(m.group(), m.group()), line)
        return WORD.sub(lambda m: like_case(fix[m.group().casefold()], m.group()) if m.group().casefold() in fix else m.group(), line) if fix else line

    return [[x if p or "`" in x or "$" in x or "](" in x else one(x), p] for x, p in segs]
