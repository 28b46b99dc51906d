"""Problem 4: visually identical text with different characters, brought to one form.

Words of the corpus in the main script of their record form vocabulary tries. Every token with an unusual character walks a
trie by a weighted edit automaton: a look-alike of the letter at an edge, another case and an ignorable character cost
nothing, another accent ACCENT, a letter put in, left out or replaced one. Within ACCENT the cheapest, then the most frequent
word is the canonical spelling. A token that no such word matches may be one letter off a word, as inflected forms are: that
word tells the script its look-alikes are to be read in, but no letter is replaced by another, which would make it another
word. Of a token of less than LONG letters all words one letter off have to be of one script, and a whole word of another
script is not told by them, as a correct short word is a letter off some word of any script. Tokens without a match are
normalized by table. A token of several words is matched word by word. A record is found if a token of it is spelled otherwise
than its canonical form, and rewritten with the canonical forms of all.

Vocabulary and tokens are cut into shards by the first letters of their skeleton, so no task holds the whole vocabulary. Words
one letter off, wherever it stands, meet by what their skeletons are without one of their letters. Tokens without a word in
them are normalized where they are found. Null and empty texts give no row. Ties between words go to the one first in order. Repeated deliveries give one row.
"""

from __future__ import annotations

import html as htmllib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

#: Letters that look like a Latin one (fixed values): other letter, Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝьвмнткАВЕКМНОРСТУХІЈЅԌԚԜгпи", "aeopcyxijshdqwbbmhtkABEKMHOPCTYXIJSGQWrnu"))
GREEK = dict(zip("αονρικτυχγεωηΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovpiktuxyewnABEZHIKMNOPTYX"))
#: Letters that can't be told apart at all, and so may stand for a whole word (fixed values).
IDENTICAL = set("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ" + "aeopcyxijshdqwABEKMHOPCTYXIJS" + "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
ROMAN = re.compile(r"[ivxlcdm]+", re.I)
STRICT_CYRILLIC = set("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌԚԜкмтвн")
LIKE = CYRILLIC | GREEK
TO_CYRILLIC = {}
for _c, _l in CYRILLIC.items():
    if _c in STRICT_CYRILLIC:
        TO_CYRILLIC.setdefault(_l, _c)
IGNORABLE = "­͏؜᠎​-‏‪-‮⁠-⁤﻿"
SPACES = "   　"
ODD = re.compile(f"[{IGNORABLE}{SPACES}‑！-～￠-￦̀-ͯ]")
GREEK_LETTER = re.compile(r"[Ͱ-Ͽἀ-῿]")
CYR = re.compile(r"[Ѐ-ԯ]")
LAT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
DROP = re.compile(f"[{IGNORABLE}]")
RUN = re.compile(rf"(?:[^\W\d_]|[{IGNORABLE}̀-ͯ])+")
TOKEN = re.compile(r"\S+")
WORD = re.compile(r"[^\W\d_]{2,}")
ACCENT, BUDGET = 0.5, 1.0
SHARD = 6
#: Letters from which the most frequent of the words one letter off tells a token's script, also that of a whole word.
LONG = 8
LEAST = 2
#: Canonical spellings that are sent to every executor; more are joined.
SENT = 500_000
TOKENS = "field_name string, rec_id bigint, token string, script string, canonical string"
CANON = "token string, script string, canonical string, matched boolean, changed boolean, open boolean"


def main_script(text: str) -> str:
    c = len(CYR.findall(text))
    return "cyrillic" if c and c > len(LAT.findall(text)) else "latin"


def skeleton(word: str) -> str:
    """One spelling for everything that looks alike: no case, accents or ignorables, Latin letters for their look-alikes.

    Capitals are compared as they stand: those of Greek look like other Latin letters than their small ones.
    """
    word = unicodedata.normalize("NFKC", DROP.sub("", word))
    word = "".join(LIKE.get(c, c) for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).casefold()
    return "".join(LIKE.get(c, c) for c in word)


def signs(word: str) -> str:
    """The characters of a word, in their case, with accents attached and without ignorables."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", DROP.sub("", word)))


def scripts(word: str) -> set[str]:
    out = set()
    for c in word:
        if CYR.match(c):
            out.add("cyrillic")
        elif GREEK_LETTER.match(c):
            out.add("greek")
        elif LAT.match(c) or "Ａ" <= c <= "ｚ":
            out.add("latin")
    return out


def reading(field: str, text: str) -> str:
    """The characters of a record: of HTML without tags, entities read."""
    if field == "html":
        text = re.sub(r"<[A-Za-z/][^<>]*>", " ", text)
        return htmllib.unescape(text) if "&" in text else text
    return text


def unusual(field: str, rec: int, text: str):
    """The tokens of a record that have a character to look into; a space that doesn't break is a token by itself."""
    text = reading(field, text)
    odd = ODD.search(text)
    cyr = CYR.search(text)
    greek = GREEK_LETTER.search(text)
    if not odd and not greek and not (cyr and LAT.search(text)):
        return
    script = main_script(text)
    seen = set()
    if odd:
        for c in set(text) & set(SPACES):
            seen.add(c)
    for m in TOKEN.finditer(text):
        token = m.group()
        if ODD.search(token):
            seen.add(token)
        elif len(token) > 1 and (greek or cyr):
            kinds = scripts(token)
            if len(kinds) > 1 or kinds and kinds != {script}:
                for run in RUN.findall(token):
                    own = scripts(run)
                    if len(run) > 1 and (len(own) > 1 or own != {script} and all(c in LIKE or c in TO_CYRILLIC for c in run)):
                        seen.add(run)
    for token in seen:
        parts = pieces(token)
        if any(asked(x, script) for x in parts) if len(parts) > 1 else word_in(token):
            yield field, rec, token, script, None
        elif (plain := by_table(token, script)) != token:
            yield field, rec, token, script, plain


def word_in(token: str) -> str:
    """The only run of two or more letters in a token; nothing if there are more or none."""
    runs = [r for r in RUN.findall(token) if len(r) > 1 and DROP.sub("", r)]
    return runs[0] if len(runs) == 1 else ""


def pieces(token: str) -> list[str]:
    """The token cut before every word of it but the first, so that each piece has one."""
    starts = [m.start() for m in RUN.finditer(token) if len(m.group()) > 1 and DROP.sub("", m.group())]
    cuts = [0, *starts[1:], len(token)]
    return [token[a:b] for a, b in zip(cuts, cuts[1:])]


def asked(piece: str, script: str) -> bool:
    """The word of a piece has a character to look into."""
    run = word_in(piece)
    kinds = scripts(run)
    return bool(ODD.search(run)) or len(kinds) > 1 or bool(kinds) and kinds != {script} and all(c in LIKE or c in TO_CYRILLIC for c in run)


def words_of_main_script(field: str):
    def words(text: str):
        text = reading(field, text)
        script = main_script(text)
        if script == "latin" and not CYR.search(text) and not GREEK_LETTER.search(text):
            return WORD.findall(text.lower())
        mine = CYR if script == "cyrillic" else LAT
        return [w for w in WORD.findall(text.lower()) if all(mine.match(c) for c in w)]

    return words


def by_table(token: str, script: str, to: str = "") -> str:
    """NFKC, no ignorables, plain spaces; letters of a mixed run go to the script `to`, else to the one most of it is in."""
    token = unicodedata.normalize("NFKC", DROP.sub("", token)).replace("‑", "-").replace("‐", "-")

    def one(m: re.Match) -> str:
        run = m.group()
        own = scripts(run)
        if len(own) < 2 or len(run) < 3:
            return run
        latin = sum(bool(LAT.match(c)) for c in run)
        cyr = sum(bool(CYR.match(c)) for c in run)
        to_latin = "".join(LIKE.get(c, c) for c in run)
        to_cyr = "".join(TO_CYRILLIC.get(LIKE.get(c, c) if GREEK_LETTER.match(c) else c, c) for c in run)
        options = [x for x in ((to_latin, to_cyr) if to == "latin" or not to and (latin > cyr or latin == cyr and script == "latin") else (to_cyr, to_latin)) if len(scripts(x)) == 1]
        return options[0] if options else run

    return RUN.sub(one, token)


BASES: dict[str, str] = {}


def base(c: str) -> str:
    """The letter that all look-alikes of a character share."""
    if (x := BASES.get(c)) is None:
        x = BASES[c] = skeleton(c)
    return x


class Trie:
    """Words in lower case; at the end of one stands how frequent it is. backward: words are entered from their last letter.

    A node is (words that end here, base letter -> letter -> node).
    """

    def __init__(self, words: list[tuple[str, int]], backward: bool = False):
        self.backward = backward
        self.root: tuple[list, dict] = ([], {})
        for word, n in words:
            node = self.root
            for c in reversed(signs(word)) if backward else signs(word):
                node = node[1].setdefault(base(c), {}).setdefault(c, ([], {}))
            node[0].append((-n, word))

    def walk(self, run: str, budget: float) -> list[tuple[float, int, str]]:
        """(cost, -n, word) of all words within the budget."""
        own = signs(run)[::-1] if self.backward else signs(run)
        best: dict[str, tuple[float, int]] = {}
        todo = [(self.root, 0, 0.0)]
        done: dict[tuple[int, int], float] = {}
        while todo:
            node, i, cost = todo.pop()
            key = (id(node), i)
            if done.get(key, 9.0) <= cost:
                continue
            done[key] = cost
            edit = cost + 1 <= budget
            if i == len(own):
                for n, w in node[0]:
                    if best.get(w, (9.0, 0))[0] > cost:
                        best[w] = (cost, n)
            else:
                c = own[i]
                # look-alikes cost nothing, letters with other accents ACCENT
                for d, child in node[1].get(base(c), {}).items():
                    extra = 0.0 if accents(c) == accents(d) else ACCENT
                    if cost + extra <= budget:
                        todo.append((child, i + 1, cost + extra))
                if not base(c) and cost + ACCENT <= budget:  # a detached accent
                    todo.append((node, i + 1, cost + ACCENT))
                if edit:
                    todo.append((node, i + 1, cost + 1))
            if edit:
                for letters in node[1].values():
                    for child in letters.values():
                        todo.append((child, i, cost + 1))
                        if i < len(own):
                            todo.append((child, i + 1, cost + 1))
        return sorted((cost, n, w) for w, (cost, n) in best.items())


ACCENTS: dict[str, str] = {}


def accents(word: str) -> str:
    if len(word) > 1 or (x := ACCENTS.get(word)) is None:
        x = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", word)) if unicodedata.combining(c))
        if len(word) == 1:
            ACCENTS[word] = x
    return x


def with_case(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def canonical(token: str, script: str, trie: Trie, own: dict[str, int], budget: float = BUDGET) -> tuple[str, bool, bool, bool]:
    """(spelling, found in the vocabulary, otherwise than the token, no word within ACCENT) of a token of one word; own: the
    words of the trie."""
    plain = by_table(token, script)
    run = word_in(token)
    if not run:
        return plain, False, plain != token, False
    kinds = scripts(unicodedata.normalize("NFKC", run))
    options = trie.walk(run, ACCENT)
    lost = not options
    near = [scripts(w) for _, _, w in trie.walk(run, budget)] if lost and budget >= 1 else []
    long = len(signs(run)) >= LONG
    told_by = near[0] if near and (long or all(x == near[0] for x in near)) else set()
    if len(kinds) == 1 and script not in kinds and not ODD.search(token):
        # a whole word of another script: only a word of the record's script in its place makes it a case
        inside = [o for o in options if scripts(o[2]) == {script}]
        if own.get(run.lower(), 0) > 0 or kinds == {"latin"} and ROMAN.fullmatch(run):
            return token, bool(own.get(run.lower())), False, False
        if not inside:
            # a word of neither vocabulary, all of letters that can't be told apart, or one letter off a word of the record's script
            like = LIKE if script == "latin" else TO_CYRILLIC
            told = not all(c in IDENTICAL for c in run) or len(run) < 3
            if long and told_by == {script} and all(c in like for c in run):
                told = False
            other = token if told else token.replace(run, "".join(like.get(c, c) for c in run))
            return other, False, other != token, lost
        options = inside
    if not options:
        if told_by:
            plain = by_table(token, script, next(iter(told_by)))
        return plain, False, plain != token, lost
    if len(kinds) > 1:
        options = [o for o in options if scripts(o[2]) <= kinds | {script}] or options
    word = with_case(options[0][2], DROP.sub("", unicodedata.normalize("NFKC", run)))
    spelled = unicodedata.normalize("NFC", by_table(token.replace(run, word), script))
    return spelled, True, spelled != token, False


def key_of(token: str) -> str:
    """The skeleton of the word of a token, one character for each of its letters."""
    return "".join(b if len(b := base(c)) < 2 else c.lower() for c in signs(word_in(token) or token))


def vocabulary(texts: list[tuple[str, DataFrame]], least: int = LEAST) -> DataFrame:
    """(word, n) over all texts; texts: field and a frame of one column."""
    all_words = None
    for field, df in texts:
        one = C.counted(df, words_of_main_script(field))
        all_words = one if all_words is None else all_words.unionByName(one)
    return all_words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def with_keys(df: DataFrame, column: str) -> DataFrame:
    def run(value, *rest):
        yield value, key_of(value), *rest

    rest = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join([f"{column} string", "key string"] + [f"{f.name} {f.dataType.simpleString()}" for f in rest])
    return C.arrow_rows(df.select(column, *[f.name for f in rest]), run, schema)


def walked(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """CANON rows of distinct (token, key, script), each by the words within ACCENT among those of its shard of (word, key, n)."""
    shard = F.substring("key", 1, SHARD).alias("shard")
    mine = tokens.select("token", "script", shard)
    known = words.select("word", "n", shard).join(mine.select("shard").distinct(), "shard", "left_semi")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["token", "script", "canonical", "matched", "changed", "open"]
        if left.empty:
            return pd.DataFrame({n: [] for n in names})
        own = dict(zip(right.word, right.n.astype(int)))
        trie = Trie(list(own.items()))
        return pd.DataFrame([(t, s, *canonical(t, s, trie, own, ACCENT)) for t, s in zip(left.token, left.script)], columns=names)

    return mine.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(one, CANON)


#: A key, and it without one of its letters: two keys that are one letter apart have one of these in common.
REDUCED = "explode(array_distinct(concat(array(key), if(key = '', array(), transform(sequence(1, length(key)), i -> concat(substring(key, 1, i - 1), substring(key, i + 1)))))))"


def walked_near(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """CANON rows of distinct (token, key, script), each by all words of (word, key, n) within BUDGET."""
    pairs = tokens.select("token", "script", F.expr(REDUCED).alias("reduced")).join(words.select("word", "n", F.expr(REDUCED).alias("reduced")), "reduced")
    near = pairs.groupBy("token", "script").agg(F.collect_set(F.struct("word", "n")).alias("near"))

    def run(token, script, near):
        own = {x["word"]: x["n"] for x in near or ()}
        yield token, script, *canonical(token, script, Trie(list(own.items())), own)

    return C.arrow_rows(tokens.select("token", "script").join(near, ["token", "script"], "left"), run, CANON)


def spellings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Canonical spelling of each distinct (token, script), and of the pieces of those of several words; words: (word, n)."""
    words = C.cut(with_keys(words, "word"))

    def cut_up(token, script):
        parts = pieces(token)
        for x in dict.fromkeys(parts):
            if len(parts) == 1 or asked(x, script):
                yield token, script, x

    parts = C.cut(C.arrow_rows(tokens.select("token", "script").distinct(), cut_up, "token string, script string, part string"))
    single = C.cut(with_keys(parts.select(F.col("part").alias("token"), "script").distinct(), "token"))
    first = C.cut(walked(single, words))
    near = walked_near(single.join(first.where("open").select("token", "script"), ["token", "script"], "left_semi"), words)
    each = C.cut(first.where("not open").unionByName(near).drop("open"))

    def together(token, script, by):
        of = {x["part"]: x for x in by}
        out = unicodedata.normalize("NFC", "".join(of[x]["canonical"] if x in of else by_table(x, script) for x in pieces(token)))
        yield token, script, out, all(x["matched"] for x in by), out != token

    several = parts.where("token <> part").join(each.withColumnRenamed("token", "part"), ["part", "script"]).groupBy("token", "script").agg(F.collect_list(F.struct("part", "canonical", "matched")).alias("by"))
    return each.unionByName(C.arrow_rows(several, together, "token string, script string, canonical string, matched boolean, changed boolean"))


def lookalikes(records: list[tuple[str, DataFrame]]) -> DataFrame:
    """(field_name, rec_id, token, canonical, matched) of all tokens that are spelled otherwise than their canonical form."""
    tokens = None
    for _, df in records:
        one = C.arrow_rows(C.narrow(df), unusual, TOKENS)
        tokens = one if tokens is None else tokens.unionByName(one)
    tokens = C.cut(C.once(tokens))
    words = vocabulary([(field, df.select("text")) for field, df in records])
    open_ = tokens.where("canonical is null").drop("canonical")
    spelled = C.cut(spellings(open_, words).where("changed").drop("changed"))
    by_word = open_.join(F.broadcast(spelled) if spelled.count() <= SENT else spelled, ["token", "script"])
    out = tokens.where("canonical is not null").withColumn("matched", F.lit(False)).unionByName(by_word)
    return out.select("field_name", "rec_id", "token", "canonical", "matched")


REWRITTEN = "field_name string, rec_id bigint, clean string"
PART = re.compile(rf"[{SPACES}]|\S+")
MARKUP = re.compile(r"(<[A-Za-z/][^<>]*>)")


def rewritten(field: str, text: str, spelled: dict[str, str]) -> str:
    """The record with its tokens in their canonical spelling; of HTML the tags stay, and entities become characters where they can."""

    def run(m: re.Match) -> str:
        return spelled.get(m.group(), m.group())

    def part(m: re.Match) -> str:
        token = m.group()
        return spelled.get(token, token) if ODD.search(token) else RUN.sub(run, token)

    if field != "html":
        return PART.sub(part, text) if spelled else text
    if not spelled and "&" not in text:
        return text
    out = MARKUP.split(text)
    for i in range(0, len(out), 2):
        plain = htmllib.unescape(out[i])
        new = PART.sub(part, plain)
        if new != out[i]:
            out[i] = htmllib.escape(new, quote=False)
    return "".join(out)


def normalized(records: list[tuple[str, DataFrame]]) -> DataFrame:
    """(field_name, rec_id, clean): every record with the canonical spellings of its tokens in place."""
    by = lookalikes(records).groupBy("field_name", "rec_id").agg(F.collect_set(F.struct("token", "canonical")).alias("spelled"))
    every = None
    for _, df in records:
        one = C.once(C.narrow(df), "field_name", "rec_id")
        every = one if every is None else every.unionByName(one)

    def run(field, rec, text, spelled):
        yield field, rec, rewritten(field, text, {x["token"]: x["canonical"] for x in spelled or ()})

    return C.arrow_rows(every.join(by, ["field_name", "rec_id"], "left").select("field_name", "rec_id", "text", "spelled"), run, REWRITTEN)


def inputs(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [("body", C.bodies(spark, sf_dir)), ("html", C.block_html(spark, sf_dir))]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes(inputs(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(inputs(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes(inputs(spark, sf_dir)).select("field_name", "rec_id").distinct()
