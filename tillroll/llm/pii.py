"""PII: keyed, type-consistent surrogates for personal data and secrets.

Detected are e-mail addresses, IPv4 addresses, payment cards, social security
numbers, phone numbers, access keys, values of password-like settings, and
persons (a title or a known given name before capitalised words).  An entity is
replaced by a surrogate derived from a key, its type and its normal form, so
every mention of it, in any document and any notation, gets the same one:

* digits keep their places, a card keeps its first digit and a valid check
  digit, a phone its country code, a social security number starts with 9;
* an address moves to the reserved block 240.0.0.0/4;
* an e-mail keeps the shape of its local part, and equal domains share a
  surrogate domain under the reserved ``.example``;
* a secret keeps its alphabet (hexadecimal, upper case, ...), length and
  punctuation; the value of a setting ends at white space or a quote, a mark
  that ends a clause is not part of it, and it has six characters or more;
* a given name becomes one of the same gender and script (a keyed permutation
  of the list, so different names stay different), a surname a made-up one of
  the same script.

Collision checks run over the corpus-wide table of distinct entities: where two
entities of a type share a surrogate, or a surrogate is itself an entity of the
corpus, all but one are hashed again until none is left.  Only those rare
entities need a join; all others are replaced inside the row, so texts are
never shuffled.  Everything is built from DataFrame functions.

A null text stays null, an empty one empty.  Repeated rows and equal ids are
replaced row by row.  Other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Staging

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Charlotte", "Isabelle",
                     "Francesca", "Katharina", "Brigitte", "Guadalupe", "Beatrice", "Madeleine", "Ursula", "Valeria"),
    ("latin", "m"): ("Michael", "Robert", "William", "Christopher", "Matthew", "Anthony", "Jonathan", "François",
                     "Wolfgang", "Friedrich", "Alejandro", "Francisco", "Sebastian", "Guillaume", "Giovanni", "Benjamin"),
    ("cyrillic", "f"): ("Екатерина", "Наталья", "Светлана", "Татьяна", "Людмила", "Галина", "Марина", "Ольга"),
    ("cyrillic", "m"): ("Александр", "Дмитрий", "Сергей", "Николай", "Владимир", "Михаил", "Андрей", "Виктор"),
    ("greek", "f"): ("Ελένη", "Κατερίνα", "Βασιλική", "Δήμητρα"),
    ("greek", "m"): ("Γεώργιος", "Δημήτριος", "Νικόλαος", "Παναγιώτης"),
}
# Forms of address.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mme", "Monsieur", "Madame", "Herr", "Frau", "Señor", "Señora", "г-н", "г-жа")
# Syllables of made-up surnames.
SYLLABLES = {
    "latin": ("bar", "cor", "dal", "fen", "gil", "har", "jos", "kel", "lan", "mor", "nev", "pol", "ros", "sal", "tor", "win"),
    "cyrillic": ("бар", "вол", "гор", "дан", "жар", "зим", "кор", "лев", "мир", "нов", "пол", "рос", "сол", "тур", "фед", "чер"),
    "greek": ("βαρ", "γαλ", "δαμ", "ζαχ", "θεο", "καλ", "λαμ", "μαν", "νικ", "ξεν", "παπ", "ριζ", "σαρ", "τρι", "φιλ", "χαρ"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_GIVEN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"
_TITLE = "(?:" + "|".join(TITLES) + r")\.?"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,24}",
    "setting": rf"(?<![A-Za-z]){_LABEL}(?=[^\s\"'\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^\s\"']{{6,}}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)",
    "person": rf"(?<![\p{{L}}])(?:{_TITLE}\s{_NAME}(?:\s{_NAME})?|{_GIVEN}\s{_NAME})",
}
_PERSON_STARTS = "".join(sorted({n[0] for names in (TITLES, *GIVEN.values()) for n in names}))
PERSON = f"(?=[{_PERSON_STARTS}]){PATTERNS['person']}"
PATTERN = "|".join(f"(?:{p})" for p in [*(v for k, v in PATTERNS.items() if k != "person"), PERSON])
_NOT_ONLY_PERSONS = "[0-9@=:]"
_CLAUSE_END = r"[.,;:!?)\]}>]*$"
MOST_ATTEMPTS = 64
SAME_LENGTH_ATTEMPTS = 8


def _kind(m: Column) -> Column:
    """The first type whose pattern matches the whole mention."""
    out = F.lit("phone")
    for name in reversed([n for n in PATTERNS if n != "phone"]):
        # look-around at the ends has been settled by the search
        out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _value(m: Column) -> Column:
    """The value of a password-like setting, without its label and the marks behind it."""
    return F.regexp_replace(m, f"^{_LABEL}|{_CLAUSE_END}", "")


def described(mentions_: Column) -> Column:
    """Each mention with its kind, entity type and normal form; persons are described word by word.

    Built in steps, each a transform of the one before, so that no part of the
    expression is repeated.
    """
    out = F.transform(mentions_, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))

    def entity(x):
        m, kind = x["m"], x["kind"]
        type_ = F.when(kind.isin("setting", "access_key"), "secret").otherwise(kind)
        norm = (F.when(kind.isin("card", "ssn", "phone"), _digits(m)).when(kind == "email", F.lower(m))
                .when(kind == "setting", _value(m)).otherwise(m))
        words = F.when(kind == "person", F.split(m, r"\s")).otherwise(F.array().cast("array<string>"))
        return F.struct(m.alias("m"), kind.alias("kind"), type_.alias("type"), norm.alias("norm"), F.transform(words, lambda w: F.struct(
            w.alias("w"), F.concat(F.lit("surname_"), _script(w)).alias("type"), F.lower(w).alias("norm"),
            w.rlike(f"^(?:{_TITLE}|{_GIVEN})$").alias("listed"))).alias("words"))
    return F.transform(out, entity)


def units(mentions_: Column) -> Column:
    """The entities named by mentions: ``array<struct<type, norm>>``."""
    pair = lambda x: F.struct(x["type"].alias("type"), x["norm"].alias("norm"))
    return F.flatten(F.transform(described(mentions_), lambda x: F.when(
        x["kind"] == "person", F.transform(F.filter(x["words"], lambda w: ~w["listed"]), pair)).otherwise(F.array(pair(x)))))


class Surrogates:
    """Column expressions of the keyed replacements."""

    def __init__(self, key: str):
        self.key = key
        self._given = {}
        for group, names in GIVEN.items():
            moved = list(names)
            # a cyclic order by key: no name maps to itself
            random.Random(f"{key}|{group}").shuffle(moved)
            self._given |= dict(zip(moved, moved[1:] + moved[:1]))

    def _stream(self, type_: Column, norm: Column, attempt: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.key), type_, norm, attempt.cast("string")), 512)

    @staticmethod
    def _byte(stream: Column, i: Column) -> Column:
        return F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def _alike(self, value: Column, stream: Column) -> Column:
        """Each character replaced by one of its class, other scripts by Latin; hexadecimal values stay hexadecimal."""
        hexa = value.rlike("^[0-9a-f]+$")
        pick = lambda alphabet, v: F.substr(F.lit(alphabet), F.pmod(v, F.lit(len(alphabet))) + 1, F.lit(1))

        def one(c, i):
            v = self._byte(stream, i)
            return (F.when(hexa, pick("0123456789abcdef", v)).when(c.rlike("[0-9]"), pick("0123456789", v))
                    .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", v))
                    .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v))
                    .when(c.rlike(r"[\p{L}\p{M}\p{N}]"), pick("abcdefghijklmnopqrstuvwxyz", v)).otherwise(c))
        return F.array_join(F.transform(F.split(value, ""), one), "")

    def _number(self, digits: Column, stream: Column, kept: Column) -> Column:
        """All digits after the first ``kept`` replaced."""
        return F.array_join(F.transform(F.split(digits, ""), lambda c, i: F.when(i < kept, c).otherwise(
            F.pmod(self._byte(stream, i), F.lit(10)).cast("string"))), "")

    @staticmethod
    def _checked(digits: Column) -> Column:
        """The number with its last digit set to the Luhn check digit."""
        n = F.length(digits)
        body = F.substr(digits, F.lit(1), n - 1)
        doubled = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
            i % 2 == 0, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
        total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
        return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))

    def canonical(self, type_: Column, norm: Column, attempt: Column, stream: Column) -> Column:
        """The surrogate of an entity in normal form."""
        domain = self._stream(F.lit("domain"), F.regexp_extract(norm, "@(.*)$", 1), F.lit(0))
        email = F.concat(self._alike(F.regexp_extract(norm, "^([^@]*)", 1), stream),
                         F.when(attempt > 0, attempt.cast("string")).otherwise(""),
                         F.lit("@h"), F.substr(domain, F.lit(1), F.lit(12)), F.lit(".example"))
        ip = F.concat_ws(".", 240 + F.pmod(self._byte(stream, F.lit(0)), F.lit(15)),
                         *[self._byte(stream, F.lit(i)) for i in (1, 2, 3)])
        kept = F.when(type_ == "card", 1).when(type_ == "phone", F.greatest(F.length(norm) - 10, F.lit(0))).otherwise(0)
        number = F.transform(F.array(self._number(norm, stream, kept)), lambda n: F.when(type_ == "card", self._checked(n)).when(
            type_ == "ssn", F.concat(F.lit("9"), F.substr(n, F.lit(2), F.lit(8)))).otherwise(n))[0]
        return (F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "secret", self._secret(norm, attempt, stream))
                .when(type_.startswith("surname_"), self._surname(type_, attempt, stream)).otherwise(number))

    def _surname(self, type_: Column, attempt: Column, stream: Column) -> Column:
        listed = F.when(type_ == "surname_cyrillic", F.lit(list(SYLLABLES["cyrillic"]))).when(
            type_ == "surname_greek", F.lit(list(SYLLABLES["greek"]))).otherwise(F.lit(list(SYLLABLES["latin"])))
        # a longer name for each further attempt
        return F.array_join(F.transform(F.sequence(F.lit(0), 3 + attempt), lambda i: F.element_at(
            listed, F.pmod(self._byte(stream, i), F.lit(16)) + 1)), "")

    def of(self, frame: DataFrame) -> DataFrame:
        """``frame (type, norm, attempt, ...)`` with the surrogate ``s``."""
        one = F.struct("type", "norm", "attempt", self._stream(F.col("type"), F.col("norm"), F.col("attempt")).alias("stream"))
        return frame.withColumn("s", F.transform(F.array(one), lambda x: self.canonical(
            x["type"], x["norm"], x["attempt"], x["stream"]))[0])

    def _secret(self, value: Column, attempt: Column, stream: Column) -> Column:
        # a value with few letters and digits has few surrogates of its length
        return F.concat(F.regexp_extract(value, "^(AKIA|)", 1), self._alike(F.regexp_replace(value, "^AKIA", ""), stream),
                        F.when(attempt >= SAME_LENGTH_ATTEMPTS, attempt.cast("string")).otherwise(""))

    def render(self, mentions_: Column, attempt_of) -> Column:
        """The replacements of mentions, each in its own notation."""
        given = F.create_map(*[F.lit(x) for pair in self._given.items() for x in pair])

        def tried(x, *names):
            return F.struct(*[x[n].alias(n) for n in names], attempt_of(x["type"], x["norm"]).alias("attempt"))

        def streamed(x, *names):
            return F.struct(*[x[n].alias(n) for n in (*names, "attempt")],
                            self._stream(x["type"], x["norm"], x["attempt"]).alias("stream"))

        def word(x):
            made = F.initcap(self._surname(x["type"], x["attempt"], x["stream"]))
            return F.when(x["w"].rlike(f"^{_TITLE}$"), x["w"]).otherwise(F.coalesce(F.try_element_at(given, x["w"]), made))

        def written(x):
            m, kind, core = x["m"], x["kind"], x["core"]
            # the i-th digit of the mention takes the i-th digit of the surrogate
            placed = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(
                c.rlike(r"\d"), F.substr(core, F.length(_digits(F.substr(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
            words = F.transform(x["words"], lambda w: tried(w, "w", "type", "norm"))
            words = F.transform(words, lambda w: streamed(w, "w", "type", "norm"))
            return (F.when(kind.isin("card", "ssn", "phone"), placed)
                    .when(kind == "person", F.array_join(F.transform(words, word), " "))
                    .when(kind == "setting", F.concat(
                        F.regexp_extract(m, f"^({_LABEL})", 1), core, F.regexp_extract(m, f"({_CLAUSE_END})", 1))).otherwise(core))

        names = ("m", "kind", "type", "norm", "words")
        out = F.transform(described(mentions_), lambda x: tried(x, *names))
        out = F.transform(out, lambda x: streamed(x, *names))
        out = F.transform(out, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["words"].alias("words"), F.when(
            x["kind"] != "person", self.canonical(x["type"], x["norm"], x["attempt"], x["stream"])).alias("core")))
        return F.transform(out, written)


def mentions(text: Column) -> Column:
    """All mentions in a text, from the left.

    Every kind but a person needs a digit, an ``@`` or the mark behind a setting's label: texts without get the short pattern.
    """
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.when(text.rlike(_NOT_ONLY_PERSONS), find(PATTERN)).when(text.rlike(PERSON), find(PERSON)).otherwise(
        F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``(type, norm)`` of a corpus."""
    found = docs.select(mentions(F.col(text_col)).alias("m")).where(F.size("m") > 0)
    return found.select(F.explode(units(F.col("m"))).alias("u")).select("u.type", "u.norm").distinct()


def second_tries(known: DataFrame, surrogates: Surrogates, staging: Staging) -> DataFrame:
    """``(type, norm, attempt)`` of the entities whose first surrogate is not free."""
    state = staging.put(surrogates.of(known.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(MOST_ATTEMPTS):
        shared = (state.groupBy("type", "s").agg(F.count("*").alias("c"), F.min(F.struct("attempt", "norm")).alias("first"))
                  .where("c > 1"))
        clash = (state.join(shared, ["type", "s"])
                 .where(F.struct("attempt", "norm") != F.col("first")).select("type", "norm"))
        real = (state.select("type", "norm", "s").alias("a")
                .join(state.select(F.col("type").alias("t2"), F.col("norm").alias("n2")), (F.col("type") == F.col("t2")) & (F.col("s") == F.col("n2")))
                .select("type", "norm"))
        again = staging.put(clash.unionAll(real).distinct().withColumn("again", F.lit(1)), "again")
        if not again.limit(1).count():
            return state.where("attempt > 0").select("type", "norm", "attempt")
        old = state
        state = state.join(again, ["type", "norm"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again", "s")
        state = staging.put(surrogates.of(state), "surrogates")
        staging.drop(old, again)
    raise RuntimeError("the surrogate space is too small for the entities found")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced, and their number as ``n_entities``."""
    staging = Staging(docs.sparkSession, "pii")
    surrogates = Surrogates(key)
    known = staging.put(entities(docs, text_col), "entities")
    retried = staging.put(second_tries(known, surrogates, staging), "retried")
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*names).withColumn("__m", mentions(F.col(text_col)))
    if retried.limit(1).count():
        # only documents that name such an entity take part in the join
        named = (docs.select(F.col(id_col).alias("__id"), mentions(F.col(text_col)).alias("m")).where(F.size("m") > 0)
                 .select("__id", F.explode(units(F.col("m"))).alias("u")).select("__id", "u.type", "u.norm").distinct()
                 .join(retried, ["type", "norm"]))
        tries = staging.put(named.groupBy("__id").agg(F.map_from_entries(F.collect_list(
            F.struct(F.concat_ws("|", "type", "norm"), "attempt"))).alias("__tries")), "tries")
        rows = rows.join(tries, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
        attempt_of = lambda t, n: F.coalesce(F.try_element_at(F.col("__tries"), F.concat_ws("|", t, n)), F.lit(0))
    else:
        attempt_of = lambda t, n: F.lit(0)
    # the pattern that found the mentions also cuts the text between them
    cut = lambda p: F.split(F.col(text_col), p, -1)
    gaps = F.when(F.col(text_col).rlike(_NOT_ONLY_PERSONS), cut(PATTERN)).otherwise(cut(PERSON))
    made = F.concat(surrogates.render(F.col("__m"), attempt_of), F.array(F.lit("")))
    text = F.when(F.size("__m") > 0, F.array_join(F.zip_with(gaps, made, lambda g, s: F.concat(g, s)), "")).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in names],
                       F.coalesce(F.size("__m"), F.lit(0)).alias("n_entities"))
