"""PII replaced by surrogates.

Detected entities are brought to a canonical value (digits of a phone number,
lower-case address, words of a name); every distinct value gets one keyed
surrogate, so an entity is the same everywhere it is mentioned, and the
surrogate is written in the form of each mention: letters stay letters of
their script and case, digits digits, a card keeps its issuer digit and its
check sum, a name its title's gender.  Names go by word, so a surname is the same
behind any title, with a given name and bare in the text of a mention.  Surrogates that two values share, or
that are a real value of the corpus, are drawn again until all are distinct.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import fresh, small_side, stored, text_key

# Titles by gender, and given names and syllables of surnames by script.
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Господин|Г-н|Κύριος"
TITLES_F = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Госпожа|Г-жа|Κυρία"
TITLES_N = "Dr|Prof|Доктор|Δρ"
GIVEN = {
    "latin": ("Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul".split(),
              "Anna Berta Clara Dora Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula".split()),
    "cyrillic": ("Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(), "Анна Вера Галина Дарья Елена Зоя Ирина Ксения".split()),
    "greek": ("Άρης Γιώργος Δημήτρης Θανάσης Κώστας Μάριος Νίκος Πέτρος".split(), "Άννα Βασιλική Δήμητρα Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split()),
}
SYLLABLES = {"latin": "ba bel cor dan der fen gar hol jan kel lin mar nor ost pel ran sel tor ven wil".split(),
             "cyrillic": "ба бел вол гор дан ков лин мар нов пет ром сол тов фед чер яр".split(),
             "greek": "βα γε δη θα κα λε μα νι πα ρο σι τα φι χρι".split()}

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
CARD = r"(?<![\d-])(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
#: Country calling codes of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: A word of a name, with hyphens and apostrophes inside.
WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-?\p{Lu}\p{Ll}+)*"
NAME = rf"(?<!\p{{L}})(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? {WORD}(?: {WORD}){{0,2}}"
ANY = f"{EMAIL}|{IP}|{CARD}|{PHONE}|{NAME}"
KINDS = ["email", "ip", "card", "phone", "name"]


def kind_of(raw: Column) -> Column:
    digits = F.length(F.regexp_replace(raw, r"\D", ""))
    return (F.when(raw.contains("@"), "email").when(raw.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(raw.rlike(r"^\p{L}"), "name")
            .when((digits >= 15) & ~raw.startswith("+"), "card").otherwise("phone"))


def _words(raw: Column) -> Column:
    """A mention of a name without its title."""
    return F.regexp_extract(raw, rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? (.*)$", 1)


def _gender(raw: Column) -> Column:
    return F.when(raw.rlike(rf"^(?:{TITLES_F})\.? "), "f").when(raw.rlike(rf"^(?:{TITLES_M})\.? "), "m").otherwise("n")


def canonical(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common; names go by word (:func:`name_words`).

    A phone number is its calling code, a hyphen and the rest; one without a
    plus sign has the form of calling code 1.
    """
    digits = F.regexp_replace(raw, r"\D", "")
    phone = F.when(raw.startswith("+"), F.regexp_replace(digits, rf"^({CALLING}|\d{{3}})", "$1-")).otherwise(F.concat(F.lit("1-"), digits))
    return (F.when(kind == "email", F.lower(raw)).when(kind == "card", digits).when(kind == "phone", phone)
            .otherwise(raw))


def _draw(digest: Column, place: Column | int, n: int) -> Column:
    """Number below n that follows from the keyed digest and a place."""
    return F.pmod(F.xxhash64(digest, place if isinstance(place, Column) else F.lit(place)), F.lit(n)).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n + 1)


def _shaped(text: Column, digest: Column) -> Column:
    """Letters become letters of their case, digits digits; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), _draw(digest, i, 10).cast("string")).when(c.rlike("[a-z]"), _pick([chr(97 + k) for k in range(26)], _draw(digest, i, 26)))
                .when(c.rlike("[A-Z]"), _pick([chr(65 + k) for k in range(26)], _draw(digest, i, 26))).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The 15 digits with their check digit."""
    def add(s: Column, i: Column) -> Column:
        d = F.element_at(F.split(digits, ""), i).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), add)
    return F.concat(digits, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _name(value: Column, digest: Column, attempt: Column) -> tuple[Column, Column]:
    """Surname and given name, by script and gender, of a canonical name word;
    both get a syllable more each attempt."""
    gender = F.substring(value, 1, 1)

    def drawn(script: str, surname: bool) -> Column:
        male, female = GIVEN[script]
        syllables = SYLLABLES[script]

        def tail(least: int) -> Column:
            more = F.transform(F.sequence(F.lit(0), attempt + least), lambda k: _pick(syllables, _draw(digest, k + 1, len(syllables))))
            return F.array_join(F.slice(more, F.lit(1), attempt + least), "")

        if surname:
            return F.initcap(tail(4))
        given = F.when(gender == "f", _pick(female, _draw(digest, 0, len(female)))).when(gender == "m", _pick(male, _draw(digest, 0, len(male)))).otherwise(
            _pick(male + female, _draw(digest, 0, len(male) * 2)))
        return F.concat(given, tail(0))

    return tuple(F.when(value.rlike(r"\p{IsCyrillic}"), drawn("cyrillic", x)).when(value.rlike(r"\p{IsGreek}"), drawn("greek", x)).otherwise(drawn("latin", x))
                 for x in (True, False))


def _surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of a canonical value; the space it is drawn from grows with the attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value), 256)
    # Numbers of a fixed form grow late, when their form is nearly used up.
    late = F.greatest(attempt - 7, F.lit(0))
    more = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: _pick([chr(97 + k) for k in range(26)], _draw(digest, 1000 + k, 26))), "")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), late), lambda k: _draw(digest, 2000 + k, 10).cast("string")), "")
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(_shaped(local, digest), F.substring(more, F.lit(1), attempt), F.lit("@"), _shaped(F.substring_index(host, ".", 1), F.sha2(digest, 256)), F.lit(".example."),
                     F.when(host.rlike(r"\.(com|net|org)$"), F.substring_index(host, ".", -1)).otherwise("org"))
    ip = F.concat_ws(".", *[(_draw(digest, i, 223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    ip = F.when(late > 0, F.concat(ip, F.lit(":1"), F.substring(digits, F.lit(1), late))).otherwise(ip)
    card = _luhn(F.concat(F.substring(value, 1, 1), *[_draw(digest, i, 10).cast("string") for i in range(14)]))
    # A card of 15 digits keeps the two of its issuer; a zero in front changes no check digit.
    short = F.substring(_luhn(F.concat(F.lit("0"), F.substring(value, 1, 2), *[_draw(digest, i, 10).cast("string") for i in range(12)])), 2, 15)
    card = F.when(F.length(value) == 15, short).otherwise(card)
    # The country code before the hyphen stays, no number starts with 0 or 1.
    phone = F.concat(F.substring_index(value, "-", 1), F.lit("-"), (_draw(digest, -1, 8) + 2).cast("string"), _shaped(F.expr("substring(substring_index(value, '-', -1), 2)"), digest), F.substring(digits, F.lit(1), late))
    surname, given = _name(value, digest, attempt)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "surname", surname).otherwise(given)


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct canonical (kind, value).

    A surrogate that an earlier value of the kind has, or that is a value of
    the corpus, is drawn again; rounds end when none is, so equal surrogates
    mean equal values.
    """
    word = F.col("kind").isin("surname", "given")  # neither kind of name word takes a real one of the other
    real = values.select(F.when(word, "word").otherwise(F.col("kind")).alias("r_kind"), F.when(F.col("kind") == "given", F.expr("substring(value, 3)")).otherwise(F.col("value")).alias("r_value")).distinct()
    settled, open_, attempt = None, values, 0
    while True:
        now = stored(open_.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)), "surrogates")
        first = now.groupBy("kind", "surrogate").agg(F.min("value").alias("first"))
        if settled is not None:
            first = first.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = first.join(real, (F.when(word, "word").otherwise(F.col("kind")) == F.col("r_kind")) & (F.lower("surrogate") == F.col("r_value")), "left_anti")
        good = now.join(first.select("kind", F.col("first").alias("value")), ["kind", "value"], "left_semi")
        good = stored(good, "surrogates")
        settled = good if settled is None else settled.unionByName(good)
        open_ = stored(now.join(good, ["kind", "value"], "left_anti").select("kind", "value"), "surrogates")
        if not open_.count():
            return settled
        attempt += 1


def _written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the form of a mention."""
    places = F.split(raw, "")
    # A mention without a plus sign has no calling code.
    written = F.when((kind == "phone") & ~raw.startswith("+"), F.substring_index(surrogate, "-", -1)).otherwise(surrogate)
    digits = F.split(F.regexp_replace(written, r"\D", ""), "")
    number = F.transform(places, lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(digits, F.size(F.filter(F.slice(places, F.lit(1), i + 1), lambda x: x.rlike("[0-9]"))))).otherwise(c))
    extra = F.when(kind == "phone", F.array_join(F.slice(digits, F.length(F.regexp_replace(raw, r"\D", "")) + 1, F.size(digits)), "")).otherwise("")
    return F.when(kind.isin("phone", "card"), F.concat(F.array_join(number, ""), extra)).otherwise(surrogate)


def name_words(raws: DataFrame) -> DataFrame:
    """(raw, nth, word, kind, value) of the words of name mentions.  The last one
    is the surname, whatever the title; a given name behind a title without
    gender has that of its other mentions, if they agree."""
    word = raws.select("raw", _gender(F.col("raw")).alias("gender"), F.split(_words(F.col("raw")), " ").alias("words"))
    word = word.select("raw", "gender", F.size("words").alias("n"), F.posexplode("words").alias("nth", "word")).withColumn("low", F.lower("word"))
    last = F.col("nth") == F.col("n") - 1
    seen = stored(word.where(~last).groupBy("low").agg(F.max(F.col("gender") == "f").alias("f"), F.max(F.col("gender") == "m").alias("m")), "pii-given")
    word = word.join(small_side(seen, seen.count()), "low", "left")
    gender = F.when(F.col("gender") != "n", F.col("gender")).when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    return word.select("raw", "nth", "word", F.when(last, "surname").otherwise("given").alias("kind"),
                       F.when(last, F.col("low")).otherwise(F.concat_ws(" ", gender, "low")).alias("value"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity of the text replaced; adds n_<kind> columns.

    Words of a name detected in a text are replaced in all of that text, as
    written or in capitals; n_name counts the mentions with a title.

    A null text stays null, texts without entities stay as they are, repeated
    rows are treated alike and stay.  An empty table gives an empty result;
    columns of the caller that are named like an added one are replaced.
    """
    inner, = fresh(docs, "pii_key")
    flagged = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    keyed = docs.withColumn(inner, text_key(text_col))
    found = keyed.where(flagged).select(F.col(inner).alias("key"), F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0)).alias("raws"))
    found = stored(found.dropDuplicates(["key"]), "pii-texts")  # equal texts are solved once
    mentions = found.select("key", F.posexplode("raws").alias("nth", "raw")).withColumn("kind", kind_of(F.col("raw")))
    raws = stored(mentions.select("kind", "raw").distinct().withColumn("value", canonical(F.col("kind"), F.col("raw"))), "pii-mentions")
    plain, names = raws.where("kind != 'name'"), stored(name_words(raws.where("kind = 'name'")), "pii-words")
    table = surrogate_table(plain.select("kind", "value").unionByName(names.select("kind", "value")).distinct(), key)
    names = stored(names.join(table, ["kind", "value"]).select("raw", "nth", "word", "kind", "surrogate"), "pii-words")
    # A group is the words of one mention.
    named = names.groupBy("raw").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]), " ").alias("surrogate"))
    named = named.select(F.lit("name").alias("kind"), "raw", F.concat(F.col("raw").substr(F.lit(1), F.length("raw") - F.length(_words(F.col("raw")))), F.col("surrogate")).alias("new"))
    written = plain.join(table, ["kind", "value"]).select("kind", "raw", _written(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    written = stored(written.unionByName(named), "pii-written")
    # A group is the name words of one text; a word that is both a surname and a given name stands for the surname.
    bare = mentions.where("kind = 'name'").select("key", "raw").distinct().join(names.select("raw", "word", "kind", "surrogate"), "raw")
    bare = bare.select("key", F.col("kind").alias("rank"), F.explode(F.array(F.struct("word", "surrogate"), F.struct(F.upper("word").alias("word"), F.upper("surrogate").alias("surrogate")))).alias("x"))
    bare = bare.groupBy("key", "x.word").agg(F.max(F.struct("rank", "x.surrogate")).alias("x")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "x.surrogate"))).alias("bare"))
    counts = [F.count_if(F.col("kind") == k).cast("long").alias(f"n_{k}") for k in KINDS]
    # A group is the mentions of one text.
    per_text = mentions.join(written, ["kind", "raw"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "new"))).alias("news"), *counts)
    per_text = stored(per_text.join(bare, "key", "left").select("key", "bare", F.transform("news", lambda x: x["new"]).alias("news"), *[f"n_{k}" for k in KINDS]), "pii-news")
    mark, news, own = fresh(keyed, "pii_mark", "pii_news", "pii_bare")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    right = per_text.withColumnsRenamed({"key": mark, "news": news, "bare": own, **{f"n_{k}": f"{mark}_{k}" for k in KINDS}})
    changed = keyed.where(flagged).join(right, F.col(inner) == F.col(mark))
    between = F.split(F.col(text_col), ANY, -1)

    def swapped(text: Column, runs: str, other) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), lambda w: F.coalesce(F.element_at(F.col(own), w), other(w))), "")

    # Words with hyphens and apostrophes as they are, else their parts.
    runs = F.transform(between, lambda x: swapped(x, r"\p{L}+(?:['’-]\p{Lu}\p{L}*)*|\P{L}+", lambda w: F.when(w.rlike("^\\p{L}+['’-]"), swapped(w, r"\p{L}+|\P{L}+", lambda v: v)).otherwise(w)))
    between = F.when(F.col(own).isNull(), between).otherwise(runs)
    text = F.array_join(F.zip_with(between, F.concat(F.col(news), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = changed.select(*[text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in {f"n_{k}" for k in KINDS}],
                             *[F.col(f"{mark}_{k}").alias(f"n_{k}") for k in KINDS])
    same = docs.where(~flagged).select(*kept, *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    return same.unionByName(changed)
