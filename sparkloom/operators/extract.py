"""Entities and relationships named in texts, by patterns and cue words.

Single patterns are Column expressions; the whole chain, which counts and scores all names of a
text, is one pass over Arrow batches.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scoring import lookup

#: Capitalised words that are no names.
COMMON = (
    "The This That These Those When Where What Why How Who Which Will Would Could Should Must Can May Might And "
    "But Or Not So Yet For Nor Because Although Since While Until Unless Before After During Through"
).split()
#: Words that are no names, English and Bulgarian.
STOP_ENGLISH = """
the and for are but not you all can had her was one our out day get has him his how its may new now old see two who boy did man men put say she too use
this that with have from they know want been good much some time very when come here just like long make many over such take than them well were will
your about after again back could every first going house little might never only other right should through under where while would write years
because before being between during without within against across around behind beside beneath beyond inside outside toward towards underneath thing
stuff something anything everything details
""".split()
STOP_BULGARIAN = """
и в на за с от до по при без е са си съм беше бяха ще би това тази тези този онзи която който които как какво къде кога защо кой не да ли че ако когато
докато или но а още само вече тук там всички всяка всеки няколко много малко го му й ги им ме ти ви ни един една едно два две три прави работи работят
има имат мога може могат трябва искам иска използва използваме използвам използват осигурява осигуряват позволява позволяват оркестрира оркестрират
върна връща връщат търсения търсене достъп данни параметри сесии сесия система системи през след преди около между над под към чрез според заради
поради различни различен различна различно семантични семантичен семантична семантично семантичните приблизително приблизителен приблизителна по-добър
по-добра по-добро по-добре висока висок високо високи вместо индексът индекса индекси използване използването начин начина начини вид вида нещо неща
всичко нищо детайли обновяване контекст пример резултат функция метод клас
""".split()
#: Shapes of names (pattern, group, least and most characters).
QUOTED = [(r"[\"']([^\"']{2,20})[\"']", 1), (r"`([^`]{2,20})`", 1), (r"\{([^}]{2,15})\}", 1), (r"\[([^\]]{2,15})\]", 1)]
COMPOUND = [
    r"\b[a-zA-Z]+-[a-zA-Z]+(?:-[a-zA-Z]+)*\b",
    r"\b[a-zA-Z]+_[a-zA-Z]+(?:_[a-zA-Z]+)*\b",
    r"\b[a-zA-Z]+\.[a-zA-Z]+(?:\.[a-zA-Z]+)*\b",
    r"\b[A-Z][a-z]*[A-Z][a-zA-Z]*\b",
]
ENDINGS = ("script", "lang", "++", "sql", "db", "api", "json", "xml", "-free", "safe")
FILES = r"\S+\.(?:rs|sql|json|toml)(?=\s|$)"
TERM = r"\b[a-z][a-z0-9_]{2,14}\b"
#: Words near which terms are taken, and how many words to each side.
NEAR = {
    "using": 2, "with": 2, "via": 2, "through": 2, "technology": 3, "system": 3, "framework": 3, "library": 3,
    "protocol": 3, "method": 3, "approach": 3, "solution": 3, "tool": 2, "service": 3, "platform": 3, "engine": 3,
}
#: Endings, beginnings and parts that names often have, and words that say little.
SUFFIXES = "api db sql json xml http tcp udp".split()
PREFIXES = "micro multi auto async sync".split()
PARTS = "system service protocol framework library engine platform server client cache storage database memory thread process".split()
DULL = "thing stuff something anything everything".split()
ROLES = "engine config manager handler vectorizer controller".split()
#: Points of a name for its length (up to so many characters) and for each thing true of it.
LENGTHS = [(2, 0.1), (3, 0.3), (8, 1.0), (12, 0.8), (20, 0.5), (1 << 30, 0.2)]
POINTS = {"occurrences": 0.3, "joined": 0.4, "capitals": 0.3, "ending": 0.5, "beginning": 0.4, "part": 0.6}
DULL_FACTOR = 0.1
#: Points of a lower-case term in ASCII texts; occurrences give 2 at most, 2 are needed.
TERM_LENGTHS = [(4, 0.5), (1 << 30, 2.0)]
TERM_POINTS = {"occurrences": 0.5, "underscore": 1.5, "digit": 1.5}
TERM_MOST, TERM_LEAST = 2.0, 2.0
#: Points of a word in other texts; lengths in bytes, occurrences give 2.5 at most, 3 are needed.
WORD_LENGTHS = [(4, 1.0), (7, 2.5), (1 << 30, 3.5)]
WORD_POINTS = {"occurrences": 0.8, "joined": 3.0, "generic": 3.5, "digit": 2.0, "caseless": 3.0, "role": 2.5}
WORD_MOST, WORD_LEAST = 2.5, 3.0
#: Words after which a concept is named, and the verbs between.
CONCEPTS = "concept principle pattern approach methodology framework architecture design strategy technique algorithm model abstraction paradigm".split()
CONCEPT_VERBS = "is are was were involves uses implements provides".split()
#: Parts of names by which a type is inferred, in this order.
BY_NAME = {
    "Technology": "rust cargo postgresql postgres jwt json api http sql database redis docker kubernetes git server client".split(),
    "Problem": "bug issue problem error fail crash exception panic".split(),
    "CodeComponent": "function method struct enum trait impl module lib crate package / ::".split(),
    "Solution": "fix solution resolve implement patch update".split(),
}
#: Endings of names of technologies.
TECHNOLOGY_ENDINGS = [".rs", ".toml"]
BY_UPDATE = {"CodeChanged": "CodeComponent", "ProblemSolved": "Solution", "DecisionMade": "Decision", "ConceptDefined": "Concept"}
#: Cue words between two names, in English and Bulgarian, in this order.
CUES = [
    ("DependsOn", "depends on|depends|relies on|needs|requires|based on|зависи от|изисква|базира се на|стъпва на|се нуждае от"),
    ("Implements", "implements|extends|inherits|имплементира|реализира|наследява|разширява|внедрява"),
    ("RelatedTo", "calls|uses|invokes|connects to|connects|communicates with|използва|свързва се с|комуникира с|работи с|вика|се обръща към|има връзка с"),
    ("LeadsTo", "causes|leads to|triggers|results in|generates|starts|води до|причинява|създава|генерира|предизвиква|отключва|стартира"),
    ("Solves", "solves|fixes|resolves|handles|removes|решава|поправя|оправя|фиксва|затваря|устранява|премахва"),
]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def proper_nouns(text: Column) -> Column:
    """Lower-cased capitalised words of 3 to 20 letters, common ones left out."""
    found = F.filter(_all(text, r"(?U)\b[A-Z][a-zA-Z-]{2,}\b"), lambda w: ~w.isin(*COMMON) & (F.char_length(w) <= 20))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def quoted(text: Column) -> Column:
    found = F.concat(*(_all(text, p, g) for p, g in QUOTED))
    keep = lambda w: F.char_length(w).between(2, 15) & ~w.rlike(r"^\p{N}+$")
    return F.array_distinct(F.transform(F.filter(found, keep), lambda w: F.lower(w)))


def compounds(text: Column) -> Column:
    found = F.concat(*(_all(text, p) for p in COMPOUND))
    return F.array_distinct(F.transform(F.filter(found, lambda w: F.char_length(w).between(4, 25)), lambda w: F.lower(w)))


def files(text: Column) -> Column:
    return F.array_distinct(F.filter(_all(text, FILES), lambda w: F.char_length(w) > 5))


def concepts(text: Column) -> Column:
    """Lower-cased concepts a text states: what follows a concept word and a verb, quoted definitions,
    and names in mixed capitals."""
    between = lambda least, most: lambda w: F.char_length(w).between(least, most)
    said = _all(text, rf"(?:{'|'.join(CONCEPTS)})\s+(?:{'|'.join(CONCEPT_VERBS)})\s+([a-zA-Z][a-zA-Z\s]{{2,30}})", 1)
    quoted_ = _all(F.lower(text), r"(?:concept\s+of|definition|principle)\s+[\"']([^\"']{2,25})[\"']", 1)
    trimmed = F.transform(F.concat(said, quoted_), lambda w: F.regexp_replace(w, r"^\s+|\s+$", ""))
    mixed = F.filter(_all(text, r"\b[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*\b"), between(4, 20))
    return F.array_distinct(F.transform(F.concat(F.filter(trimmed, between(3, 25)), mixed), lambda w: F.lower(w)))


def light_names(text: Column) -> Column:
    """The names that need no counting: capitalised, compound."""
    return F.array_distinct(F.concat(proper_nouns(text), compounds(text)))


def _up_to(table: list[tuple[int, float]], n: int) -> float:
    return next(points for most, points in table if n <= most)


def _points(table: dict[str, float], facts: dict[str, float]) -> float:
    return sum(table[k] * v for k, v in facts.items())


class Namer:
    """Finds and scores the names of one text; patterns are compiled once per worker."""

    def __init__(self):
        self.shapes = [(re.compile(r"\b[A-Z][a-zA-Z-]{2,}\b"), 0, 3, 20), *((re.compile(p), g, 2, 15) for p, g in QUOTED), *((re.compile(p), 0, 4, 25) for p in COMPOUND)]
        self.piece, self.term, self.file = re.compile(r"\w+(?:\+\+|-free\b)?"), re.compile(TERM), re.compile(FILES)
        self.of_name = {k: re.compile(p) for k, p in (("joined", "[-_]"), ("ending", f"(?:{'|'.join(SUFFIXES)})$"), ("beginning", f"^(?:{'|'.join(PREFIXES)})"), ("part", "|".join(PARTS)))}
        self.of_word = {k: re.compile(p) for k, p in (("joined", "[-_]"), ("generic", "[<>]"), ("digit", r"\d"), ("role", f"(?:{'|'.join(ROLES)})$"))}
        self.stop, self.common = frozenset(STOP_ENGLISH), frozenset(COMMON)
        self.stop_all = self.stop | frozenset(STOP_BULGARIAN)

    def _ascii(self, text: str, low: str) -> set[str]:
        names = set()
        for pattern, group, least, most in self.shapes:
            names.update(w.lower() for w in (m.group(group) for m in pattern.finditer(text)) if least <= len(w) <= most and not w.isnumeric() and w not in self.common)
        for w, n in Counter(self.term.findall(low)).items():
            facts = {"underscore": "_" in w, "digit": any(map(str.isdigit, w))}
            if _up_to(TERM_LENGTHS, len(w)) + min(TERM_POINTS["occurrences"] * n, TERM_MOST) + _points(TERM_POINTS, facts) >= TERM_LEAST:
                names.add(w)
        names.update(w for w in set(self.piece.findall(low)) if w.endswith(ENDINGS) and 3 <= len(w) <= 20)
        names.update(w for w in self.file.findall(text) if len(w) > 5)
        words = low.split()
        for w, reach in NEAR.items():
            if w in words:
                i = words.index(w)
                names.update(x for x in words[max(0, i - reach) : i + reach + 1] if x != w and 3 <= len(x) <= 20 and x not in self.stop)
        return names

    def _other(self, text: str) -> set[str]:
        """Names of a text in any script: words by length, frequency and shape; quoted words; files."""
        words = text.split()
        bare = Counter(re.sub(r"^[^\w-]+|[^\w-]+$", "", w).lower() for w in words)
        names = {w[1:-1] for w in words if len(w) > 2 and w[0] == w[-1] and w[0] in "`\"'" and 3 <= len(w) - 2 <= 25}
        names.update(w for w in words if w.endswith((".rs", ".sql", ".json", ".toml", ".md")))
        for w, n in bare.items():
            size = len(w.encode("utf-8", "replace"))
            if 3 <= size <= 35 and w not in self.stop_all:
                facts = {k: bool(p.search(w)) for k, p in self.of_word.items()} | {"caseless": not any(map(str.isalpha, w))}
                if _up_to(WORD_LENGTHS, size) + min(WORD_POINTS["occurrences"] * n, WORD_MOST) + _points(WORD_POINTS, facts) >= WORD_LEAST:
                    names.add(w)
        return names

    def score(self, name: str, low: str) -> float:
        """Relevance of a name in a text: LENGTHS and POINTS."""
        facts = {k: bool(p.search(name)) for k, p in self.of_name.items()} | {"occurrences": low.count(name.lower()), "capitals": name != name.lower()}
        return round((_up_to(LENGTHS, len(name)) + _points(POINTS, facts)) * (DULL_FACTOR if name in DULL else 1), 6)

    def names(self, text: str | None, n: int) -> list[tuple[str, float]]:
        """The ``n`` best names with their scores, ties by name."""
        if not text:
            return []
        low, kept = text.lower(), set()
        if not text.isascii():
            return sorted(((w, self.score(w, low)) for w in self._other(text)), key=lambda x: (-x[1], x[0]))[:n]
        for w in self._ascii(text, low):
            w = w.strip(string.punctuation.replace("(", "").replace(")", "").replace("+", "")).removesuffix("()")
            w = "Mutex" if w == "mutex" else w
            if 2 <= len(w) <= 30 and not w.isnumeric() and w.capitalize() not in self.common:
                kept.add(w)
        return sorted(((w, self.score(w, low)) for w in kept), key=lambda x: (-x[1], x[0]))[:n]


def extract(df: DataFrame, key: str, text: str = "text", n: int = 20) -> DataFrame:
    """key, name, score, nth: the ``n`` most relevant names of each text, ties by name.

    One pass over Arrow batches; nothing is shuffled. Null and empty texts have no names."""
    schema = T.StructType([df.schema[key], T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("nth", T.IntegerType())])

    def run(batches):
        namer = Namer()
        for b in batches:
            found = [namer.names(t, n) for t in b.column(1).to_pylist()]
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [(w, s, k + 1) for f in found for k, (w, s) in enumerate(f)]
            columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *columns], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def entity_type(update_type: Column, name: Column) -> Column:
    low, by_name = F.lower(name), None
    for kind, parts in BY_NAME.items():
        pattern = "|".join([*map(re.escape, parts), *(re.escape(x) + "$" for x in TECHNOLOGY_ENDINGS if kind == "Technology")])
        by_name = F.when(low.rlike(pattern), kind) if by_name is None else by_name.when(low.rlike(pattern), kind)
    return F.coalesce(lookup(BY_UPDATE, update_type, None), by_name.otherwise("Concept"))


def relationships(texts: DataFrame, names: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, src, dst, relation: names of one text with a cue word between their first mentions.

    ``names`` holds at most a few names per text (see ``extract``), so the pairs of a text are few."""
    t = texts.select(key, F.lower(text).alias("__t"))
    at = names.select(key, "name").join(t, key).withColumn("at", F.expr("instr(__t, lower(name))")).where("at > 0")
    a = at.select(key, F.col("name").alias("src"), F.col("at").alias("i"), "__t")
    b = at.select(key, F.col("name").alias("dst"), F.col("at").alias("j"))
    between = F.substring("__t", F.col("i") + F.char_length("src"), F.col("j") - F.col("i") - F.char_length("src"))
    pairs = a.join(b, key).where(F.col("j") >= F.col("i") + F.char_length("src")).select(key, "src", "dst", between.alias("m"))
    relation = None
    for kind, words in CUES:
        relation = F.when(F.col("m").rlike(words), kind) if relation is None else relation.when(F.col("m").rlike(words), kind)
    return pairs.select(key, "src", "dst", relation.alias("relation")).where("relation IS NOT NULL")


def decode_tags(tagged: DataFrame, least: float = 0.7) -> DataFrame:
    """Entities of a tagged token table (text_id, pos, token, tag, confidence): runs of one type are
    joined (``B-`` starts one, ``I-`` goes on); kept if sure enough and two characters long."""
    w = Window.partitionBy("text_id").orderBy("pos")
    kind = F.regexp_replace("tag", "^[BI]-", "")
    starts = F.col("tag").startswith("B-") | (F.lag(kind).over(w) != kind) | F.lag("pos").over(w).isNull() | (F.lag("pos").over(w) != F.col("pos") - 1)
    t = tagged.where("tag <> 'O'").withColumn("kind", kind).withColumn("starts", F.when(starts, 1).otherwise(0))
    t = t.withColumn("run", F.sum("starts").over(w))
    e = t.groupBy("text_id", "run", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("entity"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return e.where((F.col("confidence") >= least) & (F.char_length("entity") >= 2)).drop("run")


def key_points(text: Column, most: int = 2000) -> Column:
    """Texts over ``most`` characters as title and description lines, two pieces of code, five key
    lines and the beginning, joined by `` | `` and cut to the limit."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    heads = F.filter(lines, lambda x: x.rlike("^(?:Title|Description):"))
    code = F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"Code:([^|]*)"), 1), lambda x: F.concat(F.lit("Code: "), F.trim(x))), 1, 2)
    marks = r"^[-*0-9]|Performance:|Algorithm:|O\(|speedup|optimization"
    keys = F.slice(F.filter(lines, lambda x: x.rlike(marks)), 1, 5)
    intro = F.array(F.concat(F.lit("Context: "), F.regexp_replace(F.left(text, F.lit(300)), r"\s+\S*$", ""), F.lit("...")))
    return F.when(F.char_length(text) > most, F.left(F.array_join(F.concat(heads, code, keys, intro), " | "), F.lit(most))).otherwise(text)
