"""Defective responses: empty, truncated, refusal, copy of the prompt, other language.

A first pass looks at each pair by itself and finds empty responses, copies, refusals and
other languages, and brings the rest to a form: words in lower case, names and numbers made
alike. What was broken off is then decided against all responses:

* ``neighbour``: forms are range-sorted and each is compared with the next one. A response
  without an end mark whose form begins its neighbour's inside a word is a shortened version;
  one that begins it at a word is, unless finished responses end with the same words.
* ``limit``: lengths at which cut responses pile up point to a length limit; every response
  of that length without an end mark is cut there, unless a finished one has the same form.
* ``mark``: a cut mark, or an opened quotation or object that was not closed.
* ``ending``: no finished response ends with its last three words.

The language of a response is judged by character trigrams against profiles fitted on a
bounded sample of the responses (see :class:`Profile`), or against its prompt's language.
A response has one defect at most, in this order: empty, copy, refusal, other language,
truncated.

Defined results: a null response is empty; a null prompt cannot be copied; a null key stays
a null key; repeated rows count once; texts of any length are read whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Texts that stand for a missing value.
STAND_INS = {
    "", "na", "n a", "nan", "nil", "none", "null", "undefined", "unknown", "missing", "empty", "blank", "void", "tbd", "tba", "todo",
    "not available", "not applicable", "no answer", "no response", "no question", "no text", "nothing", "placeholder", "xxx",
}
SAMPLE = 10_000
# Common English function words that few other languages share.
ENGLISH = set(
    "the of which what who whom whose name names can you could say tell would be that by with to and for from this these those does did when where why how it its are were has have had been not "
    "i my am your we our they their if then follow at each any there or into over under than please must will should may might one".split()
)
# Common English nouns and adjectives, for the prior of the profiles only.
COMMON = set(
    "time year people way day man woman child world life hand part place case week work number night point home water room mother area money story fact month study book eye job word side kind "
    "head house service friend father power hour game line end member law car city team minute idea body parent face level office door health person art war history party result change morning reason "
    "girl boy air teacher force red green blue black white brown deep long short high old new small large great little good first last light heavy sea river mountain tree bird fish stone road food "
    "music paint school answer question".split()
)
# Frequent function words of other languages written in Latin letters, the prior of the profiles.
OTHERS = set(
    "der die das und ist nicht von zu den dem des ein eine wie wer wo welche wird wurde heißt gehört nach für mit sich auf "
    "le la les des est et qui que une un dans pour quel quelle où comment selon appartient s'appelle du au ne pas "
    "el los las es una por para quién cuál dónde qué según pertenece cómo fue se del con no "
    "il lo gli è di che chi quale dove secondo come si della nel per non sono "
    "o os uma quem qual onde pertence segundo do da em não foi como ao "
    "de het een van wie welke waar bij volgens is en niet naar voor met "
    "kto jest jaka który gdzie należy do według jak się nazywa nie w na z i "
    "och är som vem vad var det ett av till med inte hvem hvad hvor og på ikke er "
    "kdo je který kde jak se v na kuka mikä missä on ja ei kim nedir nerede bir ve cine este unde care și".split()
)
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»")
_PLACE = re.compile(r"\[[A-Z_]+\]|\bthis entity\b")
_NAME = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ɏ]*[a-zß-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]*")
_STARTS = re.compile(r"(?:^|[.!?:]\s+)\W*\w")
_LABEL = re.compile(r"^\W*(?:q|a|question|answer|input|output|response)\s*:\s*", re.I)
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[?!.？！。؟]['\"”’)\]*_»`\s]*$")
_CUT = re.compile(r"(?:…|\.\.+|[-‐–—,:;(/|\[{]|->)['\"”’)\]*_»`\s]*$")
_CALM = r"(?:(?:sorry|apologies|my apologies|unfortunately|regrettably|hmm+|well|thank you|thanks|no|i'?m sorry|i am sorry|i'?m afraid|i am afraid|as an? [a-z ]{2,40}|i apologi[sz]e)\b[^.!?,;:-]{0,40}[.!?,;:\s-]*(?:but\s+|that\s+)?)*"
_CANT = (
    r"(?:(?:i|we)(?:'m| am|'re| are|'d| would|'ll| will)? ?(?:really |very |simply |just |currently )?"
    r"(?:can ?not|can'?t|could ?n'?t|could not|won'?t|will not|wouldn'?t|would not|unable\b|not (?:be )?(?:able|comfortable|permitted|allowed|going|willing|in a position)|must (?:decline|refuse|pass)|"
    r"(?:have|need) to (?:decline|refuse|pass)|decline|refuse|(?:do not|don'?t) (?:feel|have|know|think|want|wish|intend|plan|provide|produce|generate|write|give|offer|answer|respond|reply|discuss|engage|assist|help|support|share|see how|understand)\b|prefer not|rather not|have no (?:way|means|idea))"
    r"|it (?:is|'s|was) ?(?:not|im)\s?possible|it'?s not possible|(?:this |the |your )?request (?:is |was |has been )?(?:declined|denied|refused|rejected)"
    r"|(?:no|not a) (?:natural )?(?:question|answer|phrasing|wording|response|reply) (?:can|could|will|may) be|(?:this|that|the \w+) (?:can ?not|can'?t) be (?:phrased|expressed|answered|turned|verbali[sz]ed|written|put))"
)
_REFUSAL = re.compile(rf"(?:^|[.!?:;]\s+){_CALM}{_CANT}", re.I)
# what is refused without "I cannot"
_OUTSIDE = re.compile(
    r"(?:^|[.!?]\s+)(?:(?:this|that|it) (?:is|falls|lies|goes) (?:outside|beyond|against)\b|(?:there is |there's )?nothing i can\b|(?:the )?(?:content|answer|question|response|text|output) (?:is )?(?:not available|unavailable|withheld|blocked|removed)\b|"
    r"please (?:consult|contact|ask|see|refer to|provide|rephrase|try)\b|(?:against|due to|because of|per) (?:my |our |the |company )?(?:policy|policies|guidelines|restrictions))",
    re.I,
)
# one plain question and nothing else: no refusal
_ASKS = re.compile(r"\W*(?:which|what|who|whom|whose|where|when|how|can you|could you)\b[^.!?;:]*\?\W*$", re.I)
_SORRY = re.compile(r"^\W*(?:i'?m sorry|i am sorry|sorry|my apologies|apologies)\b(?!.*\?\s*$)", re.I | re.S)


# characters without width, and control characters other than white space
_UNSEEN = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff\ufff9-\ufffb]+")


def _bare(text: str) -> str:
    return _UNSEEN.sub("", text)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_copy(prompt: list[str], response: list[str], lost: int = 2, lead: int = 6, tail: int = 4) -> bool:
    """Does the response hold the prompt's words in order, all but ``lost``, with little around?

    In short prompts only left-out words are forgiven; in others also changed or added ones.
    """
    m, n = len(prompt), len(response)
    if m and prompt == response:
        return True
    if m < 3 or n > m + lost + lead + tail or n < m - lost or _lcs(prompt, response) < m - lost:
        return False
    change = 1 if m >= 10 else lost + 1
    best = lost + 1
    row = [0 if j <= lead else lost + 1 for j in range(n + 1)]
    for i in range(1, m + 1):
        new = [row[0] + 1]
        for j in range(1, n + 1):
            new.append(min(row[j] + 1, new[j - 1] + change, row[j - 1] + (0 if prompt[i - 1] == response[j - 1] else change)))
        row = new
    best = min(row[max(0, n - tail) :])
    return best <= lost and m - best >= 2


class Profile:
    """Log-odds of character trigrams and whole words: another language against English.

    Counts are over distinct words, so no frequent word outweighs the rest. The prior holds
    the fixed function words above; :func:`fit_profile` adds words of sampled responses, those
    of responses rich in English function words to one side, those of responses without any
    to the other. Unseen trigrams weigh nothing.
    """

    def __init__(self, english: set[str] = frozenset(), others: set[str] = frozenset()) -> None:
        e, o = self._counts(ENGLISH | COMMON | set(english)), self._counts(OTHERS | set(others))
        ne, no, floor = sum(e.values()), sum(o.values()), 1 / max(1, len(e.keys() | o.keys()))
        self.odds = {g: math.log((o[g] / no + floor) / (e[g] / ne + floor)) for g in e.keys() | o.keys()}

    @staticmethod
    def _counts(words: set[str]) -> Counter:
        out: Counter = Counter()
        for w in words:
            t = f" {w} "
            out.update([t, *(t[i : i + 3] for i in range(len(t) - 2))])
        return out

    def score(self, words: list[str]) -> float:
        get = self.odds.get
        return sum(get(t, 0.0) + sum(get(t[i : i + 3], 0.0) for i in range(len(t) - 2)) for t in (f" {w} " for w in words))


def _script(text: str) -> bool:
    """Mostly letters that are not Latin."""
    letters = [] if text.isascii() else [c for c in text if c.isalpha()]
    return bool(letters) and sum(1 for c in letters if ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF) > 0.3 * len(letters)


def is_foreign(text: str, words: list[str], profile: Profile, least: float = 1.5) -> bool:
    """Not English, outside quotations, names and placeholders.

    A response with a third of English function words is English; else the trigrams' log-odds
    must reach ``least``, so a few rare words alone prove nothing.
    """
    if _script(text):
        return True
    known = sum(1 for w in words if w in ENGLISH)
    return len(words) >= 2 and known * 6 < len(words) and profile.score(words) > least


def _own_words(text: str) -> tuple[str, list[str]]:
    """The text without quotations, labels, placeholders and names, and its words."""
    plain = text.replace("’", "'").replace("‘", "'")
    if '"' in plain or not plain.isascii():
        plain = _QUOTED.sub(" ", plain)
    plain = _LABEL.sub("", _PLACE.sub(" ", plain))
    caseless = text == text.lower() or text == text.upper()
    bare = plain if caseless else _NAME.sub(" ", _STARTS.sub(lambda m: m.group().lower(), plain))
    return bare, _WORD.findall(bare.lower())


_PRIOR = Profile()


def look(prompt: str | None, response: str | None, profile: Profile | None = _PRIOR, like_prompt: bool = False) -> tuple[str | None, str | None]:
    """``(defect, text)``: the defect seen in the pair alone, or the text whose end is open, or neither.

    Other than English is a defect, or with ``like_prompt`` other than the prompt's language
    (English or not). Without a profile languages are not looked at.
    """
    if response is None:
        return "empty", None
    text = _bare(response).strip()
    folded = " ".join(_WORD.findall(text.lower()))
    if folded in STAND_INS:
        return "empty", None
    if text[:1] in "{[" and text[-1:] in "}]" and text[:2] != "[E":
        try:
            inner = json.loads(text)
            if isinstance(inner, dict) and "question" in inner:
                return look(prompt, inner["question"] if isinstance(inner["question"], str) or inner["question"] is None else json.dumps(inner["question"]), profile, like_prompt)
        except ValueError:
            pass
    words = folded.split()
    if text[:1] == "{":  # an object that was not closed
        return None, text
    if prompt is not None and is_copy(_WORD.findall(prompt.lower()), words):
        return "copy", None
    plain = text.replace("’", "'").replace("‘", "'")
    if '"' in plain or not plain.isascii():
        plain = _QUOTED.sub(" ", plain)
    plain = _LABEL.sub("", _PLACE.sub(" ", plain))
    if not _ASKS.match(plain) and (_REFUSAL.search(plain) or _SORRY.search(plain) or _OUTSIDE.search(plain)):
        return "refusal", None
    if profile is not None and is_foreign(*_own_words(text), profile) and not (like_prompt and prompt and is_foreign(*_own_words(_bare(prompt).strip()), profile)):
        return "other_language", None
    return None, None if _END.search(text) and not _CUT.search(text) and text.count('"') % 2 == 0 and text[:1] != "{" else text


def form(text: str) -> str:
    """Words in lower case, each word of a name, number or placeholder as ``#``."""
    t = _NAME.sub("#", _STARTS.sub(lambda m: m.group().lower(), _LABEL.sub("", _PLACE.sub(" # ", text))))
    return " ".join(re.findall(r"[^\W_]+|#", re.sub(r"\d+", "#", t).lower()))


def cut_mark(text: str) -> bool:
    """A cut mark at the end, or an open quotation or object."""
    return bool(_CUT.search(text)) or text.count('"') % 2 == 1 or text[:1] == "{"


def fit_profile(pairs: DataFrame, sample: int = SAMPLE) -> Profile:
    """Profiles of English and other words from about ``sample`` responses, picked by hash.

    A word counts for a side when two responses of that side have it, and for the other
    languages only when more of theirs have it than English ones.
    """
    total = pairs.count()
    bar = int(min(1.0, sample / max(1, total)) * (1 << 30))
    picked = pairs.where("response is not null").where(F.pmod(F.xxhash64("table_name", "row_key"), F.lit(1 << 30)) < bar).select("prompt", "response").collect()
    english, others = Counter(), Counter()
    for p, r in picked:
        if look(p, r, None)[0] is not None:
            continue
        bare, words = _own_words(_bare(r).strip())
        words = [w for w in words if w.isalpha()]
        known = sum(1 for w in words if w in ENGLISH)
        if len(words) < 3 or _script(bare):
            continue
        if 3 * known >= len(words):
            english.update(set(words))
        elif 6 * known < len(words):
            others.update(set(words))
    return Profile({w for w, n in english.items() if n >= 2}, {w for w, n in others.items() if n >= 2 and n > english[w]})


def _first_pass(pairs: DataFrame, profile: Profile, like_prompt: bool) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = ["table_name", "row_key"]
    flag = lambda n: T.StructField(n, T.BooleanType())
    schema = T.StructType([*[pairs.schema[k] for k in keys], T.StructField("defect", T.StringType()), T.StructField("form", T.StringType()), flag("opened"), flag("mark"), flag("caseless"), T.StructField("n_chars", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                d, t = look(p, r, profile, like_prompt)
                if d is not None:
                    rows.append((d, None, None, None, None, None))
                    continue
                text = _bare(r).strip()
                # names cannot be told in a text without case, so the ending of one that has a placeholder proves less
                caseless = (text == text.lower() or text == text.upper()) and re.search(r"\[[A-Za-z_]+\]", text) is not None
                rows.append((None, form(text if t is None else t), t is not None, t is not None and cut_mark(t), caseless, len(r)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(arrow)[2:], strict=True))], schema=arrow) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    return pairs.select(*keys, "prompt", "response").mapInArrow(run, schema)


def neighbours(forms: DataFrame) -> DataFrame:
    """``form, finished, goes_on`` of the opened forms: how the next form in sorted order goes on, if it begins with this one.

    ``forms(form, finished, opened)`` has distinct forms, range-sorted here; a partition's
    last form is held against the next partition's first (two rows per partition come to the
    driver). Forms that begin with this one follow it at once, those that go on at a word first.
    """
    import pyarrow as pa

    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = forms.where("form is not null").repartitionByRange(parts, "form").sortWithinPartitions("form").select("form", "finished", "opened", F.spark_partition_id().alias("part"))
    schema = T.StructType([T.StructField("form", T.StringType()), T.StructField("finished", T.BooleanType()), T.StructField("goes_on", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("rim", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, opened, out = None, False, False, []
        for b in batches:
            for x, f, o, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None:
                    out.append((x, f, None, part, "first"))
                elif opened:
                    out.append((last, done, x[len(last)] if x.startswith(last) else None, part, None))
                last, done, opened, at = x, f, o, part
        if last is not None:
            out.append((last, done, None, at, "last" if opened else "shut"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()), strict=True)], names=schema.fieldNames())

    found = materialize(placed.mapInArrow(run, schema), "neighbours")
    rims: dict[int, dict] = {}
    for r in found.where("rim is not null").collect():
        rims.setdefault(r["part"], {})["first" if r["rim"] == "first" else "last"] = r
    order, across = sorted(rims), []
    for i, n in enumerate(order):
        mine = rims[n]["last"]
        follows = rims[order[i + 1]]["first"]["form"] if i + 1 < len(order) else ""
        if mine["rim"] == "last":
            across.append((mine["form"], mine["finished"], follows[len(mine["form"])] if follows.startswith(mine["form"]) else None))
    inner = found.where("rim is null").select("form", "finished", "goes_on")
    return inner.unionByName(found.sparkSession.createDataFrame(across, "form string, finished boolean, goes_on string")) if across else inner


def length_limits(lengths: DataFrame, times: float = 4.0, least: int = 20, around: int = 5) -> DataFrame:
    """``n_chars`` at which the rows of ``lengths(n_chars)`` pile up: at least ``least`` and more than ``times`` the neighbourhood's mean (and one)."""
    n = lengths.groupBy("n_chars").agg(F.count("*").alias("n"))
    near = n.select(F.explode(F.sequence(F.col("n_chars") - around, F.col("n_chars") + around)).alias("n_chars"), "n", F.col("n_chars").alias("own"))
    sums = near.groupBy("n_chars").agg(F.sum(F.when(F.col("own") == F.col("n_chars"), F.col("n")).otherwise(0)).alias("here"), F.sum(F.when(F.col("own") != F.col("n_chars"), F.col("n")).otherwise(0)).alias("other"))
    return sums.where((F.col("here") >= least) & (F.col("here") > times * (F.col("other") / (2 * around) + 1))).select("n_chars")


def find_defects(pairs: DataFrame, profile: Profile | None = None, like_prompt: bool = False) -> DataFrame:
    """``table_name, row_key, defect, evidence`` from ``pairs(table_name, row_key, prompt, response)``.

    ``evidence`` says by what a truncated response was found, and is null for other defects.
    """
    keys = ["table_name", "row_key"]
    first = materialize(_first_pass(pairs, profile or fit_profile(pairs), like_prompt), "looked-at")
    sound = first.where("defect is null")
    last = F.substring_index("form", " ", -3)
    ends = sound.where("not opened").select(last.alias("ending")).distinct().withColumn("ends", F.lit(True))
    known = neighbours(sound.groupBy("form").agg(F.max(~F.col("opened")).alias("finished"), F.max("opened").alias("opened")))
    judged = materialize(known.withColumn("ending", last).join(ends, "ending", "left").select("form", "finished", "goes_on", F.coalesce("ends", F.lit(False)).alias("ends")), "judged")
    opened = materialize(sound.where("opened").join(judged, "form").select(*keys, "mark", "caseless", "n_chars", "finished", "goes_on", "ends"), "opened")
    limits = length_limits(opened.where("not finished and not ends")).withColumn("limit", F.lit(True))
    evidence = (
        F.when(~F.col("finished") & ((F.col("goes_on") != " ") | (~F.col("ends") & (F.col("goes_on") == " "))), "neighbour")
        .when(F.col("mark"), "mark")
        .when(F.col("finished"), None)
        .when(F.col("limit"), "limit")
        .when(~F.col("ends") & ~F.col("caseless"), "ending")
    )
    cut = opened.join(limits, "n_chars", "left").select(*keys, evidence.alias("evidence")).where("evidence is not null")
    every = first.where("defect is not null").select(*keys, "defect", F.lit(None).cast("string").alias("evidence")).unionByName(cut.select(*keys, F.lit("truncated").alias("defect"), "evidence"))
    return every.groupBy(*keys).agg(F.min(F.struct("defect", "evidence")).alias("d")).select(*keys, "d.defect", "d.evidence")
