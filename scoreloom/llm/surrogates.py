"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, telephone and card numbers (with a valid check digit), IP addresses, social security
numbers, access keys, assigned passwords and tokens, and names after a title. A run of digits that is no card as a whole is searched
for cards between its blanks and hyphens; a name found in a text is replaced there without its title too, whole or by one of
its words, if it begins with a capital. Every distinct entity (kind and normal
form) gets one replacement, derived from a key by SHA-256: digits become digits and letters letters in the same case and
places, a number keeps its country code or first digit and its valid check digit, an address stays an address, a hexadecimal value
hexadecimal, and a name is made in its title's gender and its own script. Given and family names are entities of their own, so a family
name is replaced alike with and without the given name. So equal entities stay equal in all documents and
spellings (coreference). Replacements that coincide with one another or with an entity that really occurs are drawn
again until all are distinct; if a form has no room for that (after ``DRAWS`` draws), a digest takes its place.

A cheap test for what every entity needs (an @, a run of digits, a title and the like) comes first; only texts that pass it are searched, once, and
moved. A null text stays null; equal texts are rewritten alike, and so are repeated rows; texts of any length are read whole. Of two entities that draw
the same replacement the one that sorts first keeps it. An empty table gives an empty one. All other columns stay, whatever their names, but for
n_entities, which is set anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import materialised, scratch, spare, table, written

DRAWS = 16
DEMO_KEY = "an example; give a secret of your own"

# Titles by gender, given names by gender and script, and syllables by script.
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Г-н|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа"
MALE, FEMALE = f"{MALE}|{MALE.upper()}|Κος|Κύριος|κύριος", f"{FEMALE}|{FEMALE.upper()}|Κα|Κυρία|κυρία"
# Titles in scripts without capitals.
MALE_PLAIN, FEMALE_PLAIN = "السيد|מר|श्री", "السيدة|גברת|श्रीमती"
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Kurt Leo Martin Nils Oskar Paul",
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Ιωάννης Κώστας Λουκάς Μάριος Νίκος Ορέστης Πέτρος Σπύρος Στέφανος Φώτης",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Όλγα Ρένα Σοφία Φωτεινή",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va ve",
    "cyrillic": "ба бе бо да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва",
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε",
    "arabic": "با بو بي تا تو تي دا دو دي را رو ري سا سو سي شا شو شي فا فو في كا كو كي لا لو لي ما مو مي نا نو",
    "hebrew": "בא בו בי גא גו גי דא דו די זא זו זי חא חו חי טא טו טי כא כו כי לא לו לי מא מו מי נא נו ני רא רו",
    "devanagari": "बा बी बो दा दी दो गा गी गो जा जी जो का की को ला ली लो मा मी मो ना नी नो पा पी पो रा री रो सा सी",
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}"}  # anything else is taken for Latin
ENDINGS = {("cyrillic", "m"): "в", ("cyrillic", "f"): "ва", ("greek", "m"): "ς"}  # of family names

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*(?<=\.[A-Za-z]{2,24})"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
# Groups of digits with one blank or hyphen between, 13 digits or more in all, up to where another kind of number begins. Nothing here recurs or backtracks by length.
GROUP = r"\d++(?!\w|-(?!\d++(?!\w)))"
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!{PHONE}|{IP}|{SSN}){GROUP})*+"
CARD_SHAPE = "^(?:1[3-9]|4-4-4-[1-4]|4-4-4-4-[1-3]|4-6-[45])$"
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9+/_-]{8,}"
NAME = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?|(?<![\p{{L}}\p{{M}}])(?:{MALE_PLAIN}|{FEMALE_PLAIN}) \p{{Lo}}[\p{{L}}\p{{M}}'-]+"
ALL = "|".join((EMAIL, ACCESS, SECRET, PHONE, IP, SSN, CARD, NAME))
# What a match of ALL holds besides @ or AKIA: nine digits with little between, a digit after +, four numbers with dots, a value after = or :, or a title.
NUMBERS, ASSIGNED = r"\+\d|\d(?:[^\w\n]{0,3}\d){8}", r"[=:] ?[\"']?[A-Za-z0-9+/_-]{8}"
FOUR = r"\d\.\d{1,3}\.\d{1,3}\.\d"
TITLE = rf"(?=[{''.join(sorted({w[0] for w in '|'.join((MALE, FEMALE, MALE_PLAIN, FEMALE_PLAIN)).split('|')}))}])(?:{MALE}|{FEMALE}|{MALE_PLAIN}|{FEMALE_PLAIN})\.? \p{{L}}"
HEAD_SECRET = r"^[A-Za-z_-]+ ?[=:] ?[\"']?"
HEAD_NAME = rf"^(?:{MALE}|{FEMALE}|{MALE_PLAIN}|{FEMALE_PLAIN})\.? "


def _digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn(digits: Column, odd: int) -> Column:
    """Sum of Luhn's rule; odd: the parity of the places from the right that are doubled."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == odd, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), (_luhn(digits, 1) % 10 == 0) & (digits.cast("decimal(20,0)") > 0)).otherwise(False)


def kind_of(found: Column) -> Column:
    """The kind of a match, null for a number whose check digit is wrong."""
    whole = lambda p: found.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email").when(whole(ACCESS), "access").when(whole(SECRET), "secret").when(whole(PHONE), "phone").when(whole(IP), "ip").when(whole(SSN), "ssn")
        .when(whole(r"\d(?:[ -]?\d){12,18}"), F.when(_is_card(_digits_of(found)), "card")).when(whole(NAME), "name")
    )


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once also for use in inner functions."""
    return F.get(F.transform(F.array(value), f), 0)


def pieces(found: Column) -> Column:
    """A match as its pieces in order: itself, or, for a run of digits that is nothing as a whole, the cards in it and what stands between.

    From left to right a card in a usual shape goes first, then the longest one in which no card of a usual shape begins."""

    def spans(groups: Column) -> Column:
        digits = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")
        shape = lambda i, n: F.array_join(F.transform(F.slice(groups, i + 1, n), lambda g: F.length(g).cast("string")), "-")
        valid = lambda i: F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), lambda n: _is_card(digits(i, n)))
        longest = lambda lengths: F.coalesce(F.array_max(lengths), F.lit(0))
        at = lambda i: _let(valid(i), lambda v: F.struct(longest(F.filter(v, lambda n: shape(i, n).rlike(CARD_SHAPE))).alias("usual"), longest(v).alias("any")))
        return F.transform(F.sequence(F.lit(0), F.size(groups) - 1), at)

    def chosen(span: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            x = F.get(span, i)
            free = ~F.exists(F.slice(span, i + 2, F.greatest(x["any"] - 1, F.lit(0))), lambda y: y["usual"] > 0)
            n = F.when(i < s["free"], 0).when(x["usual"] > 0, x["usual"]).when((x["any"] > 0) & free, x["any"]).otherwise(0)
            return _let(n, lambda n: F.when(n > 0, F.struct((i + n).alias("free"), F.concat(s["out"], F.array(F.struct(i.alias("a"), n.alias("n")))).alias("out"))).otherwise(s))

        none = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<a:int,n:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(span) - 1), none, step)["out"]

    def cut(tokens: Column, cards: Column) -> Column:
        """``tokens``: the groups and, between them, their separators."""
        after = lambda k: F.when(k > 0, F.get(cards, k - 1)["a"] + F.get(cards, k - 1)["n"]).otherwise(0)
        first = lambda p: F.when(p > 0, 2 * p - 1).otherwise(0)
        part = lambda lo, n: F.array_join(F.slice(tokens, lo + 1, n), "")
        both = F.flatten(F.transform(cards, lambda x, k: F.array(part(first(after(k)), 2 * x["a"] - first(after(k))), part(2 * x["a"], 2 * x["n"] - 1))))
        rest = first(after(F.size(cards)))
        return F.filter(F.concat(both, F.array(part(rest, F.size(tokens) - rest))), lambda x: x != "")

    searched = _let(F.split(found, "(?<=[ -])|(?=[ -])"), lambda tokens: _let(_let(_let(F.split(found, "[ -]"), spans), chosen), lambda cards: cut(tokens, cards)))
    return F.when(found.rlike("^[0-9][0-9 -]{12,}$") & kind_of(found).isNull(), searched).otherwise(F.array(found))


def name_forms(pos: Column, norm: Column, surrogate: Column) -> Column:
    """How a name may be said without its title: whole, then by one of its words; each with what takes its place."""
    words, puts = F.split(F.substring(norm, 3, 1 << 30), " "), F.split(surrogate, " ")
    whole = F.array(F.struct(F.lit(0).alias("part"), pos.alias("pos"), F.substring(norm, 3, 1 << 30).alias("said"), surrogate.alias("put")))
    single = F.transform(words, lambda w, i: F.struct(F.lit(1).alias("part"), pos.alias("pos"), w.alias("said"), F.coalesce(F.get(puts, i), surrogate).alias("put")))
    return F.when(F.size(words) > 1, F.concat(whole, single)).otherwise(whole)


def _mention(names: Column) -> Column:
    """A pattern of the names (letters, hyphens, apostrophes and blanks only), longer ones first, that begin with a capital."""
    by_length = F.array_sort(F.transform(F.array_distinct(F.transform(names, lambda x: x["said"])), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.concat(F.lit(r"(?<![\p{L}\p{M}])(?=\p{Lu})(?iu:"), F.array_join(F.transform(by_length, lambda x: x["w"]), "|"), F.lit(r")(?![\p{L}\p{M}])"))


def _without_names(part: Column, pattern: Column, names: Column) -> Column:
    def put(said: Column) -> Column:
        to = F.get(F.filter(names, lambda x: x["said"] == F.lower(said)), 0)["put"]
        return F.coalesce(F.when(F.upper(said) == said, F.upper(to)).otherwise(to), said, F.lit(""))

    said = F.regexp_extract_all(part, pattern, F.lit(0))
    return F.array_join(F.transform(F.split(part, pattern, -1), lambda s, i: F.concat(s, put(F.get(said, i)))), "")


def normal_form(kind: Column, found: Column) -> Column:
    name = F.regexp_replace(found, HEAD_NAME, "")
    gender = F.when(found.rlike(rf"^(?:{FEMALE}|{FEMALE_PLAIN})\.? "), "f").otherwise("m")
    return (
        F.when(kind == "email", F.lower(found)).when(kind == "phone", F.regexp_replace(found, r"[^\d+]", "")).when(kind.isin("card", "ssn"), _digits_of(found))
        .when(kind == "secret", F.regexp_replace(found, HEAD_SECRET, "")).when(kind == "name", F.concat(gender, F.lit(":"), F.lower(name))).otherwise(found)
    )


def entities_of(kind: Column, norm: Column) -> Column:
    """What a match stands for: itself, or the given and the family name; the latter has no gender where its form shows none."""
    gender, words = F.substring(norm, 1, 2), F.split(F.substring(norm, 3, 1 << 30), " ")
    shows = norm.rlike("|".join(SCRIPTS[s] for s in {script for script, _ in ENDINGS}))
    family = F.struct(F.lit(1).alias("part"), F.lit("family").alias("entity"), F.concat(F.when(shows, gender).otherwise("-:"), F.element_at(words, -1)).alias("form"))
    given = F.struct(F.lit(0).alias("part"), F.lit("given").alias("entity"), F.concat(gender, F.get(words, 0)).alias("form"))
    itself = F.struct(F.lit(0).alias("part"), kind.alias("entity"), norm.alias("form"))
    return F.when(kind != "name", F.array(itself)).when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))


def _poured(form: Column, stream: Column, hexadecimal: Column) -> Column:
    """``form`` with its digits and ASCII letters replaced by those of ``stream`` (hexadecimal digits), in place and case."""
    digit, letter = F.translate(stream, "abcdef", "051627"), F.translate(stream, "0123456789", "ghkmnprtwz")

    def one(c: Column, i: Column) -> Column:
        at = i + 1
        return (
            F.when(c.rlike("[0-9]"), F.when(hexadecimal, F.substring(stream, at, F.lit(1))).otherwise(F.substring(digit, at, F.lit(1))))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, F.substring(stream, at, F.lit(1))).otherwise(F.substring(letter, at, F.lit(1))))
            .when(c.rlike("[A-Z]"), F.upper(F.substring(letter, at, F.lit(1)))).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), one), "")


def draw(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The replacement of an entity's normal form in one draw."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt)))
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 64).cast("int")), lambda i: F.sha2(F.concat(seed, i.cast("string")), 256)), "")
    byte = lambda k: F.conv(F.substring(stream, 2 * k + 1, 2), 16, 10).cast("int")
    is_hex = norm.rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & norm.rlike("[0-9]")
    country = F.regexp_extract(norm, r"^\+(?:1|7|\d\d)", 0)
    rest = F.substring(norm, F.length(country) + 1, F.length(norm))
    phone = F.concat(country, F.regexp_replace(_poured(rest, stream, F.lit(False)), "^[01]", "5"))
    body = F.concat(F.substring(norm, 1, 1), F.substring(_poured(norm, stream, F.lit(False)), F.lit(2), F.length(norm) - 2))
    card = F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string"))
    ip = F.concat_ws(".", *[(byte(k) % 254 + 1).cast("string") for k in range(4)])
    top = F.regexp_extract(norm, r"\.[a-z]+$", 0)
    email = F.concat(_poured(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), stream, F.lit(False)), top)

    def coined(script: str, syllables: int) -> Column:
        known = F.array(*map(F.lit, SYLLABLES[script].split()))
        return F.initcap(F.concat(*[F.element_at(known, byte(k) % 32 + 1) for k in range(syllables)]))

    def family(script: str) -> Column:
        return F.concat(coined(script, 3 + min(attempt, 8)), F.when(norm.startswith("f:"), ENDINGS.get((script, "f"), "")).when(norm.startswith("m:"), ENDINGS.get((script, "m"), "")).otherwise(""))

    def given(script: str) -> Column:
        if attempt > 1 or (script, "m") not in GIVEN:
            return coined(script, 2 + min(attempt, 8))
        pick = lambda k: F.when(norm.startswith("f:"), F.element_at(F.array(*map(F.lit, GIVEN[script, "f"].split())), byte(k) % 16 + 1)).otherwise(F.element_at(F.array(*map(F.lit, GIVEN[script, "m"].split())), byte(k) % 16 + 1))
        return F.concat_ws("-", *[pick(20 + k) for k in range(1 + attempt)])

    def by_script(of) -> Column:
        out = F
        for script, letters in SCRIPTS.items():
            out = out.when(norm.rlike(letters), of(script))
        return out.otherwise(of("latin"))

    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
        .when(kind == "family", by_script(family)).when(kind == "given", by_script(given))
        .when(kind == "access", F.concat(F.lit("AKIA"), F.substring(_poured(norm, stream, F.lit(False)), 5, 64))).otherwise(_poured(norm, stream, is_hex))
    )


def taken_form(kind: Column, surrogate: Column) -> Column:
    """A surrogate as a normal form, to compare it with what really occurs."""
    return F.when(kind.isin("given", "family"), F.lower(surrogate)).otherwise(surrogate)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct entities (kind, norm): no two of a kind get the same, none gets one that occurs."""
    real = entities.select("kind", F.when(F.col("kind").isin("given", "family"), F.substring("norm", 3, 1 << 30)).otherwise(F.col("norm")).alias("form")).distinct()
    pending, done = entities, None
    for attempt in range(DRAWS):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("norm"), attempt, key)).withColumn("form", taken_form(F.col("kind"), F.col("surrogate")))
        free = drawn.join(real, ["kind", "form"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", taken_form(F.col("kind"), F.col("surrogate")).alias("form")), ["kind", "form"], "left_anti")
        won = materialised(free.groupBy("kind", "form").agg(F.min(F.struct("norm", "surrogate")).alias("w")).select("kind", "w.norm", "w.surrogate"))
        done = won if done is None else done.union(won)
        pending = materialised(pending.join(won, ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            return done
    return done.union(pending.withColumn("surrogate", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm"), 256)))


def written_as(kind: Column, found: Column, surrogate: Column) -> Column:
    """The replacement in the form of this occurrence."""
    count = lambda i: F.length(_digits_of(F.substring(found, F.lit(1), i + 1)))
    digits = _digits_of(surrogate)
    poured = F.array_join(F.transform(F.filter(F.split(found, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, count(i), F.lit(1))).otherwise(c)), "")
    loud = lambda c: F.when((F.upper(found) == found), F.upper(c)).otherwise(c)
    return (
        F.when(kind.isin("phone", "card", "ssn"), poured).when(kind == "email", loud(surrogate))
        .when(kind == "secret", F.concat(F.regexp_extract(found, HEAD_SECRET, 0), surrogate)).when(kind == "name", F.concat(F.regexp_extract(found, HEAD_NAME, 0), loud(surrogate))).otherwise(surrogate)
    )


def may_hold(text: Column) -> Column:
    """False only for texts in which ALL finds nothing."""
    return F.coalesce(text.contains("@") | text.contains("AKIA") | text.rlike(NUMBERS) | text.rlike(FOUR) | text.rlike(ASSIGNED) | text.rlike(TITLE), F.lit(False))


def anonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of its texts replaced; adds n_entities."""
    with scratch() as lasting:
        return _anonymised(docs, key, text, lasting)


def _anonymised(docs: DataFrame, key: str, text: str, lasting) -> DataFrame:
    keep = docs.drop("n_entities")
    own, h_, put_, names_, n_, parts_, mention_, text_ = spare(keep, "key", "h", "put", "names", "n", "parts", "mention", "text")
    may = may_hold(F.col(text))
    h = F.unhex(F.md5(F.col(text).cast("binary")))
    found = keep.where(may).select(h.alias("h"), F.regexp_extract_all(text, F.lit(ALL), 0).alias("all")).where(F.size("all") > 0).groupBy("h").agg(F.first("all").alias("all"))
    found = found.select("h", F.posexplode("all").alias("pos", "run")).select("h", "pos", F.posexplode(pieces(F.col("run"))).alias("sub", "found")).withColumn("kind", kind_of(F.col("found")))
    found = found.withColumn("norm", normal_form(F.col("kind"), F.col("found"))).select("*", F.inline_outer(F.when(F.col("kind").isNotNull(), entities_of(F.col("kind"), F.col("norm")))))
    found = written(found)
    named = assigned(materialised(found.where("kind is not null").select(F.col("entity").alias("kind"), F.col("form").alias("norm")).distinct()), key)
    named = named.select(F.col("kind").alias("entity"), F.col("norm").alias("form"), "surrogate")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("surrogate").isNotNull(), F.struct("part", "surrogate")))), lambda x: x["surrogate"]), " ")
    put = found.join(named, ["entity", "form"], "left").groupBy("h", "pos", "sub", "found", "kind", "norm").agg(whole.alias("surrogate"))
    put = put.select(
        "h", "pos", "sub", "kind", F.when(F.col("kind").isNull(), F.col("found")).otherwise(written_as(F.col("kind"), F.col("found"), F.col("surrogate"))).alias("put"),
        F.when(F.col("kind") == "name", name_forms(F.col("pos"), F.col("norm"), F.col("surrogate"))).alias("forms"),
    )
    put = put.groupBy(F.col("h").alias(h_)).agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "put"))).alias(put_), F.array_sort(F.flatten(F.collect_list("forms"))).alias(names_), F.count("kind").alias(n_))
    put = lasting(written(put))
    changed = keep.where(may).withColumn(own, h).join(put, F.col(own) == F.col(h_), "left")
    changed = changed.withColumn(parts_, F.when(F.col(h_).isNotNull(), F.split(text, ALL, -1))).withColumn(mention_, F.when(F.size(names_) > 0, _mention(F.col(names_))))
    said = F.aggregate(parts_, F.lit(0).cast("long"), lambda n, s: n + F.regexp_count(s, F.col(mention_)))
    changed = changed.withColumn("n_entities", F.coalesce(F.col(n_) + F.coalesce(said, F.lit(0)), F.lit(0)).cast("long"))
    changed = changed.withColumn(parts_, F.when(F.col(mention_).isNull(), F.col(parts_)).otherwise(F.transform(parts_, lambda s: _without_names(s, F.col(mention_), F.col(names_)))))
    pairs = F.transform(put_, lambda x: F.concat(F.when(x["sub"] == 0, F.get(parts_, x["pos"])).otherwise(""), x["put"]))
    changed = changed.withColumn(text_, F.when(F.col(h_).isNull(), F.col(text)).otherwise(F.concat(F.array_join(pairs, ""), F.element_at(parts_, -1))))
    changed = changed.select(*[F.col(text_).alias(c) if c == text else F.col(f"`{c}`") for c in keep.columns], "n_entities")
    return changed.union(keep.where(~may).withColumn("n_entities", F.lit(0).cast("long")))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY).select("doc_id", "n_entities", "text")
