"""Surrogates for personal data: keyed, type-consistent and distinct. Built-in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import attach, keyed, rows_with, stored

# Words of a name, with apostrophes (O'Brien, d'Arc), initials, hyphens and what stands between them in lower case. Their number has no bound.
PARTICLES = "af|al|av|bin|da|dal|das|de|degli|dei|del|della|den|der|des|di|do|dos|du|el|ibn|la|las|le|los|ten|ter|van|vom|von|y|zu|zum|zur"
WORD = r"(?:[dl]['’])?\p{Lu}(?:\p{L}|['’](?=\p{Lu}))*+"
NAME = rf"(?:(?:{PARTICLES}) )*+(?:\p{{Lu}}\. ?(?=\p{{Lu}}))*+{WORD}(?:[ -](?:(?:{PARTICLES}) )*+(?:\p{{Lu}}\. ?(?=\p{{Lu}}))*+{WORD})*+"
# What counts as an entity, as Java patterns in order of preference. Each begins only where a word
# or number can begin, and its repeats are possessive or of a fixed format, so that a search takes linear time.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"\b(?:(?i:password|passwd|pwd|token|secret|api[_-]?key)\s*+[=:]\s*+[\"']?[A-Za-z0-9+/_-]{8,}+(?:[.~][A-Za-z0-9+/_-]++)*+=*+[\"']?|AKIA[A-Z0-9]{16}+\b)",
    "ip": r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?[\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8}|0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d(?:[ .]\d{2}){4})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:(?: ?[a-z]{4})?(?: ?\d{4}){2,7}+(?: ?\d{1,3})?|[a-z0-9]{11,30}+))(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19}+)(?![\p{L}\p{N}])",
    "female": r"\b(?:Mrs|Ms|Miss|Mme|Madame|Mademoiselle|Frau|Sra|Señora|Señorita|Doña|г-жа|κυρία)\b\.? " + NAME,
    "neutral": r"\b(?:Dr|Prof|Professor|Professorin|Doktor|Docteur|Doctor|Doctora)\b\.? " + NAME,
    "male": r"\b(?:Mr|Monsieur|Herrn?|Sr|Señor|Don|г-н|κύριος)\b\.? " + NAME,
}
# Syllables and endings of made-up names by script and gender.
SYLLABLES = {
    "Cyrillic": "ба ве ги до жу за ки ло ма не па ри со ту фе хо",
    "Greek": "βα γε δι ζο θα κε λι μο νυ πα ρε σι το φα χε ψι",
    "Latin": "ba ce di fo gu ha ke li mo nu pa re si to va we",
}
ENDINGS = {("Cyrillic", "female"): "на", ("Cyrillic", "male"): "н", ("Greek", "female"): "α", ("Greek", "male"): "ος", ("Latin", "female"): "na", ("Latin", "male"): "n"}
# What comes before the part of a mention that is replaced.
KEEP = {"secret": r"^(?:AKIA|\w+(?:-\w+)?\s*[=:]\s*[\"']?)", "female": r"^[^ ]+ ", "male": r"^[^ ]+ ", "neutral": r"^[^ ]+ "}
PERSONS = ("female", "neutral", "male")

#: What the first characters of a kind look like: a quick test before the pattern itself.
GATES = {
    "secret": "(?=[PpTtSsAa])", "ip": "(?=[0-9])", "ipv6": "(?=[0-9A-Fa-f]{0,4}:)", "ssn": "(?=[0-9])", "phone": "(?=[0-9+(])",
    "iban": "(?=[A-Za-z]{2}[0-9])", "card": "(?=[0-9])", "female": "(?=[MFSDгκ])", "neutral": "(?=[DP])", "male": "(?=[MHSDгκ])",
}
ANY = "|".join(f"{GATES.get(k, '')}(?:{p})" for k, p in PATTERNS.items())
#: What every mention has some of: a text without it has none.
NEEDED = r"[0-9@=:]|AKIA|M(?:rs?|s|iss|me|adame|ademoiselle|onsieur)\b|Frau|Herr|Sr|Señor|Do[nñkc]|Dr|Prof|г-|κ[υύ]ρ"
#: Rounds of new surrogates for entities whose surrogate another entity has; rounds after which names of hosts and mailboxes get longer.
MAX_ROUNDS, GROWING = 30, 6


#: What parts the words of a name.
GAP = r"[ -]|(?<=\.)(?=\p{L})"


def _by_type(kind: Column, cases: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in reversed(cases.items()):
        out = F.when(kind == name, value).otherwise(out)
    return out


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _body(kind: Column, mention: Column) -> Column:
    """The part of a mention that is replaced."""
    out = mention
    for name, pattern in KEEP.items():
        out = F.when(kind == name, F.regexp_replace(mention, pattern, "")).otherwise(out)
    return F.when(kind == "secret", F.regexp_replace(out, "[\"']$", "")).otherwise(out)


def _entities(kind: Column, body: Column) -> Column:
    """The entities of a mention, as (kind, name): its own, or the words of a person's name, or an address's mailbox and domain.

    Forms of one number, address or name are one entity.
    """
    one = lambda k, name: F.struct(k.alias("kind"), name.alias("name"))
    digits = F.regexp_replace(body, r"\D", "")
    words = F.split(F.lower(body), GAP)

    def person(gender: str) -> Column:
        kinds = lambda w, i: F.when(w.rlike(f"^(?:{PARTICLES})?$"), "other").when((i == 0) & (F.size(words) > 1), f"given-{gender}").otherwise("surname")
        return F.transform(words, lambda w, i: one(kinds(w, i), w))

    name = _by_type(
        kind,
        {"phone": F.regexp_replace(digits, r"^1(?=\d{10}$)", ""), "card": digits, "ssn": digits, "ipv6": F.lower(body), "iban": F.upper(F.regexp_replace(body, " ", ""))},
        body,
    )
    address = F.array(one(F.lit("mailbox"), F.lower(body)), one(F.lit("domain"), F.lower(F.substring_index(body, "@", -1))))
    return _by_type(kind, {"email": address, **{g: person(g) for g in PERSONS}}, F.array(one(kind, name)))


def _stream(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """64 keyed bytes as hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), name, F.lit(key)), 512)


def _substituted(value: Column, stream: Column, lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Character by character: digits for digits, letters for letters of the same case, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        byte = F.conv(F.substring(stream, (i % 64) * 2 + 1, 2), 16, 10).cast("int")
        pick = lambda alphabet: F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))
        return F.when(c.rlike(r"\d"), pick("0123456789")).when(c.rlike(r"\p{Lu}"), pick(lower.upper())).when(c.rlike(r"\p{L}"), pick(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_total(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _card(name: Column, stream: Column) -> Column:
    """The issuer's first digit stays; a number that passes the Luhn check gets one that passes it."""
    made = F.concat(F.substring(name, 1, 1), F.substring(_substituted(name, stream), F.lit(2), F.length(name) - 2))
    check = (10 - _luhn_total(F.concat(made, F.lit("0"))) % 10) % 10
    shift = F.when(_luhn_total(name) % 10 == 0, 0).otherwise(1 + F.conv(F.substring(stream, 127, 1), 16, 10).cast("int") % 9)
    return F.concat(made, ((check + shift) % 10).cast("string"))


def _phone(name: Column, stream: Column) -> Column:
    """As many digits; the first is 2 to 9."""
    first = (2 + F.conv(F.substring(stream, 127, 1), 16, 10).cast("int") % 8).cast("string")
    return F.concat(first, F.substring(_substituted(name, stream), F.lit(2), F.length(name) - 1))


def _ip(stream: Column) -> Column:
    byte = lambda i: (1 + F.conv(F.substring(stream, 2 * i + 1, 4), 16, 10).cast("int") % 254).cast("string")
    return F.concat_ws(".", *[byte(2 * i) for i in range(4)])


def _longer(stream: Column, attempt: Column) -> Column:
    """Letters that are added to a name when its own length has no free value."""
    return _substituted(F.repeat(F.lit("x"), F.greatest(attempt - GROWING, F.lit(0))), stream)


def _mailbox(name: Column, stream: Column, attempt: Column) -> Column:
    """Another local part at the domain as it is, so that addresses stay distinct inside their domain."""
    return F.concat(_substituted(F.substring_index(name, "@", 1), stream), _longer(stream, attempt), F.lit("@"), F.substring_index(name, "@", -1))


def _domain(name: Column, stream: Column, attempt: Column) -> Column:
    """Another host; the top level stays."""
    top = F.substring_index(name, ".", -1)
    host = F.substring(name, F.lit(1), F.length(name) - F.length(top) - 1)
    return F.concat(_substituted(host, stream), _longer(stream, attempt), F.lit("."), top)


def _modulo_97(text: Column) -> Column:
    """The text, letters read as 10 to 35, modulo 97."""

    def one(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), one)


def _iban(name: Column, stream: Column) -> Column:
    """The country stays; check digits are right where they were."""
    country, rest = F.substring(name, 1, 2), F.substring(name, F.lit(5), F.length(name) - 4)
    made = _substituted(rest, stream)
    right = _modulo_97(F.concat(rest, F.substring(name, 1, 4))) == 1
    check = F.lpad((98 - _modulo_97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(right, check).otherwise(_substituted(F.substring(name, 3, 2), F.reverse(stream))), made)


def _word(name: Column, ending: str, stream: Column, attempt: Column) -> Column:
    """A made-up word of the name's script; later rounds add syllables."""

    def made(script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script].split()))
        word = F.transform(F.sequence(F.lit(1), 4 + attempt), lambda j: F.element_at(parts, F.conv(F.substring(stream, j, F.lit(1)), 16, 10).cast("int") + 1))
        # a surname that has a woman's ending keeps one
        last = F.lit(ENDINGS[script, ending]) if ending else F.when(name.rlike("[ая]$"), "ва").otherwise("") if script == "Cyrillic" else F.lit("")
        return F.concat(F.array_join(word, ""), last)

    return F.coalesce(*[F.when(name.rlike(rf"\p{{Is{s}}}"), made(s)) for s in SYLLABLES], made("Latin"))


def surrogate(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity."""
    stream = _stream(kind, name, attempt, key)
    cases = {
        "mailbox": _mailbox(name, stream, attempt),
        "domain": _domain(name, stream, attempt),
        "secret": F.when(name.rlike("^[0-9a-f]+$"), _substituted(name, stream, "abcdef")).otherwise(_substituted(name, stream)),
        "ip": _ip(stream),
        "ipv6": _substituted(name, stream, "abcdef"),
        "ssn": _substituted(name, stream),
        "phone": _phone(name, stream),
        "iban": _iban(name, stream),
        "card": _card(name, stream),
        "surname": _word(name, "", stream, attempt),
        **{f"given-{g}": _word(name, "" if g == "neutral" else g, stream, attempt) for g in PERSONS},
    }
    return _by_type(kind, cases, name)


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """kind, name, n and surrogate of every distinct entity. mentions: kind, name.

    A surrogate that two entities have, or that is itself an entity of the data, is made anew for all but the
    smallest name, round by round, until none is left.
    """
    table = mentions.where("kind <> 'other'").groupBy("kind", "name").agg(F.count("*").alias("n")).withColumn("attempt", F.lit(0))
    for _ in range(MAX_ROUNDS):
        table = stored(table.withColumn("surrogate", surrogate(F.col("kind"), F.col("name"), F.col("attempt"), key)), "entities")
        taken = table.select("kind", F.col("surrogate").alias("s"), F.struct(F.lit(1).alias("order"), "name").alias("by")).unionByName(
            table.select("kind", F.col("name").alias("s"), F.struct(F.lit(0).alias("order"), "name").alias("by"))
        )
        owner = taken.groupBy(F.col("kind").alias("of"), "s").agg(F.min("by").alias("owner"), F.count("*").alias("claims")).where("claims > 1")
        clash = stored(
            table.join(owner, (F.col("kind") == F.col("of")) & (F.col("surrogate") == F.col("s")))
            .where((F.col("owner.order") == 0) | (F.col("owner.name") != F.col("name")))
            .select("kind", "name", F.lit(True).alias("again")),
            "clashes",
        )
        if clash.isEmpty():
            return table
        table = table.join(clash, ["kind", "name"], "left").select("kind", "name", "n", (F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).alias("attempt"))
    raise ValueError(f"surrogates still collide after {MAX_ROUNDS} rounds: a kind has more entities than its format has values")


def _filled(body: Column, made: Column, wanted: str) -> Column:
    """The body with its characters of a class replaced by those of made, from the last one back."""
    skip = F.length(made) - F.length(F.regexp_replace(body, f"[^{wanted}]", ""))  # a country code before the number stays

    def one(acc: Column, c: Column) -> Column:
        at = acc["n"] + F.when(c.rlike(f"[{wanted}]"), 1).otherwise(0)
        return F.struct(F.concat(acc["out"], F.when((at > acc["n"]) & (at > 0), F.substring(made, at, F.lit(1))).otherwise(c)).alias("out"), at.alias("n"))

    return F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), skip.cast("int").alias("n")), one)["out"]


def _cased(like: Column, made: Column) -> Column:
    """made with capitals where the other string of its length has them."""
    each = F.zip_with(F.split(like, ""), F.split(made, ""), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(b))
    return F.when(F.length(like) == F.length(made), F.array_join(each, "")).otherwise(made)


def _formatted(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogates (made, an array) in the form of the mention."""
    body, first = _body(kind, mention), made[0]
    initial = lambda new: F.concat(F.upper(F.substring(new, 1, 1)), F.lit("."))
    form = lambda old, new: F.when(old.rlike(r"^\p{L}\.$"), initial(new)).when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))
    words = F.zip_with(F.split(body, GAP), made, lambda old, new: F.coalesce(form(old, new), old))
    name = F.array_join(F.zip_with(words, F.regexp_extract_all(body, F.lit(GAP), F.lit(0)), lambda w, gap: F.concat(w, F.coalesce(gap, F.lit("")))), "")
    address = F.concat(F.substring_index(first, "@", 1), F.lit("@"), made[1])
    new = _by_type(
        kind,
        {
            **dict.fromkeys(("phone", "card", "ssn"), _filled(body, first, "0-9")),
            "iban": F.when(body == F.lower(body), F.lower(_filled(F.upper(body), first, "A-Z0-9"))).otherwise(_filled(body, first, "A-Z0-9")),
            "ipv6": _cased(body, first),
            "email": _cased(body, address),
            **dict.fromkeys(PERSONS, name),
        },
        first,
    )
    head = _by_type(kind, {k: F.regexp_extract(mention, p, 0) for k, p in KEEP.items()}, F.lit(""))
    return F.when(kind == "other", mention).otherwise(F.concat(head, new, F.substring(mention, F.length(head) + F.length(body) + 1, F.length(mention))))


def replace_pii(docs: DataFrame, key: str = "lamina") -> DataFrame:
    """doc_id, text and n_entities (mentions) of each row, with every detected entity replaced by its surrogate.

    Kinds are those of PATTERNS; names count after a title only, with all their words, initials and particles (which stay). A surrogate depends on the key, the kind and the entity
    alone: the same entity gets the same one in every document and form (letter case of an address, punctuation of a
    number), different entities get different ones, and none is an entity of the data. Each word of a name is an entity,
    and an address is two, its mailbox and its domain: one surname, and one domain, is replaced alike wherever it stands,
    also after a collision. Formats stay: lengths and separators of numbers, the issuer and Luhn check of a card, country
    and check digits of an IBAN, upper and lower case, the top-level domain, the title, script and gender of a name. In
    production, the key is a secret.

    Entities are counted before the shuffle; those that make up a large share of all mentions, and rows that repeat, are
    joined by a broadcast of at most 1,024 rows (shared.attach).

    Defined cases: a null text stays null with n_entities 0; a mention may be of any length and is replaced to its end,
    a text of any length is searched as a whole; rows that repeat doc_id and text get the same result; an empty table
    gives an empty result; other columns of docs are ignored. More entities of a kind than its format has values (phone
    numbers of six digits, say) are an error after MAX_ROUNDS.
    """
    new = _replaced(docs.select("doc_id", "text"), key)
    return new.select("row.doc_id", "text", F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities"))


def clean(docs: DataFrame, key: str = "lamina") -> DataFrame:
    """The columns of docs, and every row, with the texts of replace_pii, whose cases hold; n_chars follows a text that changed."""
    return rows_with(_replaced(docs, key), docs.columns, F.col("text"))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """row (the columns of docs), the new text, and new (the surrogates in it, null without any).

    Texts are searched once. Only rows with a mention are shuffled.
    """
    rows = stored(keyed(docs).select("row", "k1", "k2", "at", F.when(F.col("text").rlike(NEEDED), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("mentions")), "searched")
    some = F.coalesce(F.size("mentions"), F.lit(0)) > 0
    found = rows.where(some).groupBy("k1", "k2").agg(F.first("mentions").alias("mentions"), F.count("*").alias("copies"))
    found = found.select("k1", "k2", "copies", F.posexplode("mentions").alias("pos", "mention"))
    found = found.withColumn("kind", F.coalesce(_kind(F.col("mention")), F.lit("other")))
    found = stored(found.withColumn("of", _entities(F.col("kind"), _body(F.col("kind"), F.col("mention")))), "mentions")
    parts = found.select("k1", "k2", "pos", F.posexplode("of").alias("j", "one")).select("k1", "k2", "pos", "j", "one.kind", "one.name")
    table = entities(parts.select("kind", "name"), key)
    made = attach(parts.where("kind <> 'other'"), table, ["kind", "name"], "n", ["surrogate"], ["k1", "k2", "pos", "j"])
    made = made.unionByName(parts.where("kind = 'other'").withColumn("surrogate", F.lit(None).cast("string")))
    made = made.groupBy("k1", "k2", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "surrogate"))), lambda x: x["surrogate"]).alias("made"))
    made = found.join(made, ["k1", "k2", "pos"]).withColumn("new", _formatted(F.col("kind"), F.col("mention"), F.col("made")))
    by_row = made.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("made"), F.first("copies").alias("copies"))
    by_row = stored(by_row.select("k1", "k2", "copies", F.transform("made", lambda x: x["new"]).alias("new")), "surrogates")
    joined = attach(rows.where(some).select("row", "k1", "k2", "at"), by_row, ["k1", "k2"], "copies", ["new"], ["at"]).withColumn("text", F.col("row.text"))
    gaps = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(gaps, "new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = joined.select("row", F.when(F.col("new").isNull(), F.col("text")).otherwise(text).alias("text"), "new")
    return changed.unionByName(rows.where(~some).select("row", F.col("row.text").alias("text"), F.lit(None).cast("array<string>").alias("new")))
