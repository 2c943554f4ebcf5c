"""Text, money, date, currency and installment expressions, all as columns."""

from __future__ import annotations

import re
import string
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


#: White space but the space itself, as `(?U)\\s` takes it. Single characters below 256 are looked up, not compared; the rest is far from most texts.
ODD_SPACE = r"(?:[\t\n\x0b\f\r\x85\xa0]|(?=[\u1680-\u3000])[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"


@cache
def iso_codes() -> tuple[str, ...]:
    """Currency codes of the running JVM (ISO 4217)."""
    from pyspark.sql import SparkSession

    found = SparkSession.active()._jvm.java.util.Currency.getAvailableCurrencies()
    return tuple(sorted(c.getCurrencyCode() for c in found))


def currency_tokens() -> list[str]:
    return sorted({*iso_codes(), *fixed.CURRENCY_SIGNS}, key=lambda t: (-len(t), t))


#: Beginnings that a pattern tries one by one.
HEADS = 6


def joined_pattern(words: list[str], spelled=re.escape) -> str:
    """One pattern for all words, shared beginnings once, longer words first: a match fails after a character or two."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    parts = [spelled(h) + joined_pattern(rest, spelled) for h, rest in sorted(heads.items())]
    if len(parts) > HEADS:  # in groups behind a look at the next character: a few comparisons instead of one for each beginning
        plain = [(spelled(h), p) for h, p in zip(sorted(heads), parts) if h.isascii()]
        groups = [plain[i : i + HEADS] for i in range(0, len(plain), HEADS)]
        seen = lambda g: "".join(h[1:-1] if h.startswith("[") else h for h, _ in g)
        rare = [p for h, p in zip(sorted(heads), parts) if not h.isascii()]
        parts = [f"(?=[{seen(g)}])(?:" + "|".join(p for _, p in g) + ")" for g in groups] + (["(?=[^\\x00-\\x7f])(?:" + "|".join(rare) + ")"] if rare else [])
    body = parts[0] if len(parts) == 1 and "" not in words else "(?:" + "|".join(parts) + ")"
    return body + "?" if "" in words else body


def any_case(char: str) -> str:
    """What `(?iu)` takes a character for, spelled out: a class of a few characters is met many times faster than a comparison that folds both sides."""
    more = {"I": "\u0131\u0130", "S": "\u017f", "K": "\u212a"}
    if char.isascii():
        return f"[{char.upper()}{char.lower()}{more.get(char.upper(), '')}]" if char.isalpha() else re.escape(char)
    return f"(?iu:{char})"


@cache
def currency_pattern() -> str:
    """All currency tokens in any case; it needs no flags."""
    return joined_pattern(currency_tokens(), any_case)


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up, at ten decimals first: binary noise doesn't decide ties."""
    return F.round(F.round(c, 10), digits)


def rounded_money(c: Column, digits: int = 2) -> Column:
    """A double rounded as SQL engines do it: half away from zero of c times a power of ten. F.round() looks at the shortest decimal that names the double instead, and rounds 71237.135 up, whose hundredfold is below the half."""
    scale = float(10**digits)
    up = lambda x: F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)
    return bound(F.abs(c) * scale, lambda x: up(x) / scale) * F.when(c < 0, -1.0).otherwise(1.0)


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.round(share.cast("decimal(6,4)") * 100, 1).cast("decimal(6,1)").cast("string")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends. Only what isn't a lone space is replaced: most texts have nothing else."""
    return F.trim(F.regexp_replace(c, rf"{ODD_SPACE}(?: |{ODD_SPACE})*| (?: |{ODD_SPACE})+", " "))


def without_artifacts(c: Column) -> Column:
    """Without the placeholders that PDF engines leave."""
    for p in fixed.ARTIFACTS:
        c = F.replace(c, F.lit(p), F.lit(" "))
    return collapse(c)


@cache
def compatibility_forms() -> tuple[str, str, str]:
    """What NFKC changes, by rule from Unicode's tables: a pattern of the sequences (a character, or a letter and a combining mark), `from\x02to\x01...` for str_to_map, and a cheap pattern that any such text meets."""
    import sys
    import unicodedata

    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    known = [c for c in map(chr, range(0xA0, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    single = [c for c in known if unicodedata.decomposition(c).startswith("<") and nfkc(c) != c]
    pairs = {unicodedata.normalize("NFD", c) for c in known if not unicodedata.decomposition(c).startswith("<")}
    pairs = sorted(p for p in pairs if len(p) == 2 and 0x300 <= ord(p[1]) <= 0x36F and len(nfkc(p)) == 1)
    ranges, codes = [], sorted(map(ord, single))
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    spelled = "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" if x < y else rf"\x{{{x:X}}}" for x, y in ranges)
    few = "".join(c for c in single if ord(c) < 0x180)
    return rf"(?:[{spelled}]|.[\u0300-\u036f])", "\x01".join(f"{x}\x02{nfkc(x)}" for x in [*single, *pairs]), rf"[{few}]|[^\x00-\u017f]"


def composed(c: Column) -> Column:
    """c in NFKC: compatibility characters (full-width letters, ligatures) by their plain ones, a letter and its mark as one character. Texts without any stay untouched."""
    pattern, table, rare = compatibility_forms()
    forms = F.str_to_map(F.lit(table), F.lit("\x01"), F.lit("\x02"))  # a constant of the plan
    parts = F.transform(F.regexp_extract_all(c, F.lit(f"(?s){pattern}|."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(forms, x), x))
    # what may be such a character is cheap to see, as no text of ASCII has one; Latin letters are not
    return F.when((F.octet_length(c) > F.char_length(c)) & c.rlike(rare) & c.rlike(pattern), F.array_join(parts, "")).otherwise(c)


def for_matching(c: Column) -> Column:
    """Lower case, dotless i as i, no-break space as space, compatibility forms composed."""
    return composed(lowered(c))


def lowered(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("ı"), F.lit("i")), F.lit("\u00a0"), F.lit(" "))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def currency(c: Column) -> Column:
    """The ISO code of a sign, name or code; null if unknown."""
    up = F.upper(F.trim(c))
    signs = F.create_map(*(F.lit(x) for kv in fixed.CURRENCY_SIGNS.items() for x in kv))
    return F.coalesce(F.try_element_at(signs, up), F.when(up.isin(*iso_codes()), up))


def without_currencies(c: Column) -> Column:
    """Currency tokens as spaces, inside words too."""
    return F.regexp_replace(c, currency_pattern(), " ")


def last_place(c: Column, mark: str) -> Column:
    """One-based place of the last mark, 0 if none."""
    back = F.instr(F.reverse(c), mark)
    return F.when(back > 0, F.length(c) - back + 1).otherwise(0)


def bound(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f names it: as a plain expression it would be repeated at each place."""
    return F.transform(F.array(c), f)[0]


def money_number(c: Column) -> Column:
    """A number with either decimal mark: the last mark decides; a lone dot not before two digits groups thousands. Null if none."""
    sign = r"^(-?)\+"
    other = r"(?s),(?=.*\.[^.,]*\z)|\.(?=.*,[^.,]*\z)"  # the mark that isn't the last one

    def read(v: Column) -> Column:
        return (
            F.when(F.contains(v, F.lit(",")), F.translate(F.regexp_replace(v, other, ""), ",", "."))
            .when(v.rlike(r"\.[^.]{2}\z"), v).otherwise(F.replace(v, F.lit("."), F.lit("")))
        )

    unsigned = bound(F.trim(c), lambda v: F.when(F.contains(v, F.lit("+")), F.regexp_replace(v, sign, "$1")).otherwise(v))
    general = bound(bound(unsigned, read), lambda x: F.when(x.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), x)).try_cast("double")
    # most numbers have one mark before two digits: these need no steps
    return F.when(c.rlike(r"^\d+[.,]\d{2}\z"), F.replace(c, F.lit(","), F.lit(".")).try_cast("double")).when(c.isNotNull(), general)


def _date(y: Column, m: Column, d: Column) -> Column:
    """A real date; null if there is none, or a part is no number."""
    year, month, day = (x.try_cast("int") for x in (y, m, d))
    full = F.when(year < 100, year + 2000).otherwise(year)
    start = F.when((month >= 1) & (month <= 12) & (full >= 1) & (full <= 9999), F.make_date(full, month, F.lit(1)))
    return F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(start))), F.date_add(start, day - 1))


def month_numbers() -> Column:
    return F.create_map(*(F.lit(x) for k, v in fixed.MONTHS.items() for x in (k, str(v))))


def date_patterns(mode: str = "strict") -> dict[str, str]:
    """Patterns of dates by the order of their parts, as they are tried. compat tries day-first before year-first and lets either start inside a longer number; strict takes whole numbers only."""
    names = "|".join(sorted(fixed.MONTHS, key=len, reverse=True))
    whole = (r"(?=\d)(?<![\d./-])", r"(?!\d)") if mode == "strict" else ("", "")
    numeric = {"year": whole[0] + f"(?:{fixed.YEAR_FIRST})" + whole[1], "day": whole[0] + f"(?:{fixed.DAY_FIRST})" + whole[1]}
    order = ["year", "day"] if mode == "strict" else ["day", "year"]
    return {"name": rf"(?iu)\d{{1,2}}\s+(?:{names})\s+\d{{4}}"} | {k: numeric[k] for k in order}


def find_date(c: Column, mode: str = "strict") -> Column:
    """struct(raw, date) of the first pattern whose leftmost match is a real date; null without one.

    compat tries day-first before year-first and lets either start inside a longer number, as the reference
    system reads `2025-01-05` as 25 January 2005. strict takes whole numbers only, year-first before day-first.
    """
    get = lambda p, i: F.get(p, F.lit(i))
    day_first = lambda p: _date(get(p, 2), get(p, 1), get(p, 0))
    year_first = lambda p: _date(get(p, 0), get(p, 1), get(p, 2))
    by_name = lambda p: _date(get(p, 2), F.try_element_at(month_numbers(), F.lower(get(p, 1))), get(p, 0))
    ways = {"name": (r"\s+", by_name), "year": ("[./-]", year_first), "day": ("[./-]", day_first)}

    def found(text: Column, pattern: str, marks: str, read) -> Column:
        # each step bound: one match, one split, one reading
        of = lambda raw: bound(bound(F.split(raw, marks), read), lambda d: F.when(d.isNotNull(), F.struct(raw.alias("raw"), d.alias("date"))))
        return bound(F.regexp_extract(text, pattern, 0), lambda raw: F.when(raw != "", of(raw)))

    return bound(c, lambda text: F.coalesce(*(found(text, p, *ways[k]) for k, p in date_patterns(mode).items())))


def with_date(rows: DataFrame, text: str, out: str, mode: str = "strict") -> DataFrame:
    """rows with the column out: find_date() of the column text, in plain columns, which Spark compiles. Only a text whose first match is no real date goes on to the other patterns in find_date()."""
    (a, p), (b, q), (c, r) = date_patterns(mode).items()
    got = lambda i: F.get("_parts", F.lit(i))
    named, year_first = F.col(f"_{a}") != "", F.col("_year") != ""
    rows = rows.withColumn(f"_{a}", F.regexp_extract(text, p, 0))
    rows = rows.withColumn(f"_{b}", F.when(~named, F.regexp_extract(text, q, 0)).otherwise(""))
    rows = rows.withColumn(f"_{c}", F.when(~named & (F.col(f"_{b}") == ""), F.regexp_extract(text, r, 0)).otherwise(""))
    rows = rows.withColumn("_raw", F.concat("_name", "_year", "_day")).withColumn("_parts", F.split("_raw", r"\s+|[./-]"))
    rows = rows.withColumn("_y", F.when(year_first, got(0)).otherwise(got(2)).try_cast("int"))
    month = F.when(named, F.try_element_at(month_numbers(), F.lower(got(1)))).otherwise(got(1))
    iso = F.concat(F.lpad(F.when(F.col("_y") < 100, F.col("_y") + 2000).otherwise(F.col("_y")).cast("string"), 4, "0"), F.lit("-"), month, F.lit("-"), F.when(year_first, got(2)).otherwise(got(0)))
    rows = rows.withColumn("_real", iso.try_cast("date"))
    found = F.when(F.col("_real").isNotNull(), F.struct(F.col("_raw").alias("raw"), F.col("_real").alias("date"))).when(F.col("_raw") != "", find_date(F.col(text), mode))
    return rows.withColumn(out, found).drop("_name", "_year", "_day", "_raw", "_parts", "_y", "_real")


@cache
def money_pattern() -> str:
    cur = currency_pattern()
    # a look at the few characters before the first number: elsewhere no currency is tried
    near = rf"(?=[^\d\s]{{0,{max(map(len, currency_tokens()))}}}+\s*+[-+]?\d++[.,]\d\d)"
    return rf"{near}({cur})?\s*({fixed.AMOUNT})\s*({cur})?"


def money_texts(c: Column) -> Column:
    """All amounts with two decimals as they stand, with the currencies around them."""
    # a line without digits before two decimals has no amount: that is cheap to see
    return F.when(has_amount(c), F.regexp_extract_all(c, F.lit(money_pattern()), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _groups(raw: Column) -> Column:
    """Currency, amount and currency of an amount as it stands, parted by a character that no amount holds: one match."""
    return F.split(F.regexp_replace(raw, money_pattern(), "$1\x01$2\x01$3"), "\x01")


def _money(raw: Column, p: Column) -> Column:
    return F.struct(raw.alias("raw"), money_number(p[1]).alias("amount"), F.coalesce(*(F.when(p[i] != "", currency(p[i])) for i in (0, 2))).alias("currency"))


def find_money(c: Column) -> Column:
    """array<struct(raw, amount, currency)> of all amounts with two decimals; a currency before wins over one after."""
    return F.transform(money_texts(c), lambda raw: bound(_groups(raw), lambda p: _money(raw, p)))


def with_money(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the column out: find_money() of the column text; a lone amount is read in plain columns, which Spark compiles."""
    several = F.transform("_raws", lambda raw: bound(_groups(raw), lambda p: _money(raw, p)))
    rows = rows.withColumn("_raws", money_texts(F.col(text))).withColumn("_lone", F.when(F.size("_raws") == 1, F.get("_raws", F.lit(0))))
    rows = rows.withColumn("_parts", F.when(F.col("_lone").isNotNull(), _groups(F.col("_lone"))))
    return rows.withColumn(out, F.when(F.col("_lone").isNotNull(), F.array(_money(F.col("_lone"), F.col("_parts")))).otherwise(several)).drop("_raws", "_lone", "_parts")


def has_amount(c: Column) -> Column:
    """Whether find_money() finds any: currencies, signs and thousands are optional, and what is left of an amount is a digit, a mark and two digits."""
    return F.coalesce(c.rlike(r"\d[.,]\d{2}"), F.lit(False))


def find_installment(c: Column) -> Column:
    """struct(current, total, raw, unit_amount, total_amount); `unit x n = sum` sets the total, `k. Taksit` the current one, `(k/n)` both."""
    a = f"({fixed.PLAIN_AMOUNT})"
    groups = lambda text, p, n: F.when(text.rlike(p), F.array(*(F.nullif(F.regexp_extract(text, p, i), F.lit("")) for i in range(n + 1))))
    get = lambda x, i: F.get(x, F.lit(i))

    def made(m: Column) -> Column:
        product, current, fraction = m["product"], m["current"], m["fraction"]
        return F.struct(
            F.coalesce(get(fraction, 1), get(current, 1)).try_cast("int").alias("current"),
            F.coalesce(get(fraction, 2), get(product, 2)).try_cast("int").alias("total"),
            F.array_compact(F.array(get(product, 0), get(current, 0), get(fraction, 0))).alias("raws"),
            money_number(get(product, 1)).alias("unit_amount"),
            money_number(get(product, 3)).alias("total_amount"),
        )

    part = lambda i: F.regexp_extract(c, fixed.INSTALLMENT_FRACTION, i)
    null, none = F.lit(None).cast("double"), F.array().cast("array<string>")
    plain = lambda current, total, raws: F.struct(current.try_cast("int").alias("current"), total.try_cast("int").alias("total"), raws.alias("raws"), null.alias("unit_amount"), null.alias("total_amount"))
    fraction = plain(part(1), part(2), F.when(part(0) != "", F.array(part(0))).otherwise(none))
    product = rf"(?i){a}\s*x\s*(\d{{1,2}})\s*=\s*{a}"
    met = lambda text: F.struct(F.when(F.contains(text, F.lit("=")), groups(text, product, 3)).alias("product"), groups(text, fixed.INSTALLMENT_CURRENT, 1).alias("current"), groups(text, fixed.INSTALLMENT_FRACTION, 2).alias("fraction"))
    # most lines have none of the three, or a fraction alone: these need no steps
    return F.when(c.isNull() | c.rlike(r"=|(?i:taksit)"), bound(bound(c, met), made)).when(F.contains(c, F.lit("(")), fraction).otherwise(plain(F.lit(None).cast("string"), F.lit(None).cast("string"), none))


def usual_pattern(mode: str = "strict") -> str:
    """A line as most are: a date of whole numbers, words without a digit, a fraction at most, one amount, a currency at most. Its groups are these."""
    # single characters below 256 are looked up, not compared; the others stand apart
    word = f"(?:[{string.ascii_letters}ÇÖÜçöü.*&'/_]++|[ĞİŞğış]++)++"
    year_first = r"|[12]\d{3}-\d\d-\d\d" if mode == "strict" else ""  # compat reads it otherwise
    amount = r"\d{1,3}(?:[.,]\d{3})++[.,]\d\d|\d++[.,]\d\d"
    months = joined_pattern(sorted(fixed.MONTHS), any_case)  # after the date's last number they would be a date by name
    return rf"^(\d\d[/-]\d\d[/-][12]\d{{3}}{year_first}) (?!{months} )({word}(?: {word})*+)(?: (\(\d{{1,2}}/\d{{1,2}}\)))? ({amount})(?: ([A-Z]{{2,3}}|[₺€$£]))?\z"


USUAL = ["_usual", "_usual_date", "_usual_fraction", "_usual_amount", "_usual_token", "_usual_currency"]


def with_usual(rows: DataFrame, text: str, mode: str = "strict") -> DataFrame:
    """rows with the columns USUAL, all null unless the column text is a line as most are: its description, date, fraction, amount, and the currency as it stands and as a code.

    One match parts such a line. It is taken only where the expressions over any text must find the same: the date is real, and no currency,
    artifact or installment stands among the words. So the words are the description, and what is found elsewhere is all there is.
    """
    got = lambda i: F.get("_parts", F.lit(i))
    rows = rows.withColumn("_parts", F.regexp_replace(text, usual_pattern(mode), "$1\x01$2\x01$3\x01$4\x01$5"))
    rows = rows.withColumn("_parts", F.when(F.col("_parts") != F.col(text), F.split("_parts", "\x01")))  # a text that matched has changed
    rows = rows.withColumns({"_words": got(1), "_day": got(0), "_usual_token": F.nullif(got(4), F.lit(""))})
    piece = lambda at, n: F.substring("_day", at, n)
    iso = F.when(F.substring("_day", 5, 1) == "-", F.col("_day")).otherwise(F.concat(piece(7, 4), F.lit("-"), piece(4, 2), F.lit("-"), piece(1, 2)))
    token = F.col("_usual_token")
    code = F.when(token == "TL", "TRY").when(token.isin(*iso_codes()), token)
    for sign in "₺€$£":
        code = code.when(token == sign, fixed.CURRENCY_SIGNS[sign])
    rows = rows.withColumns({"_usual_date": iso.try_cast("date"), "_usual_currency": code})
    # of the currencies only codes and TL are made of what words have
    rows = rows.withColumn("_upper", F.replace(F.upper("_words"), F.lit("İ"), F.lit("I")))
    coded = F.exists(F.sequence(F.lit(1), F.length("_upper") - 2), lambda i: F.col("_upper").substr(i, F.lit(3)).isin(*iso_codes())) | F.contains("_upper", F.lit("TL"))
    odd = contains_any(F.col("_words"), fixed.ARTIFACTS) | F.contains("_upper", F.lit("TAKSIT"))
    fits = F.col("_usual_date").isNotNull() & (token.isNull() | F.col("_usual_currency").isNotNull()) & ~odd & ~coded
    rows = rows.withColumn("_usual", F.when(fits, F.col("_words")))
    usual = F.col("_usual").isNotNull()
    rows = rows.withColumns({"_usual_fraction": F.when(usual, F.nullif(got(2), F.lit(""))), "_usual_amount": F.when(usual, got(3))} | {c: F.when(usual, F.col(c)) for c in ("_usual_date", "_usual_token", "_usual_currency")})
    return rows.drop("_parts", "_words", "_upper", "_day")


def fraction_installment(raw: Column) -> Column:
    """find_installment() of a fraction `(k/n)` alone, or of none (null)."""
    part = lambda i: F.when(raw.isNotNull(), F.substring_index(F.substring_index(F.btrim(raw, F.lit("()")), "/", i), "/", 1)).try_cast("int")
    null, none = F.lit(None).cast("double"), F.array().cast("array<string>")
    return F.struct(part(1).alias("current"), part(-1).alias("total"), F.when(raw.isNotNull(), F.array(raw)).otherwise(none).alias("raws"), null.alias("unit_amount"), null.alias("total_amount"))


def direction(c: Column) -> Column:
    return F.when(matching_any(c, fixed.CREDIT_WORDS), "credit").otherwise("debit")


def is_noise(c: Column) -> Column:
    return matching_any(c, fixed.NOISE_WORDS)


def matching_any(c: Column, words: list[str]) -> Column:
    # bound by transform: the text is prepared once for all words
    return F.transform(F.array(for_matching(c)), lambda x: contains_any(x, words))[0]


def strip_edges(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.EDGE))


def merchant_cleaned(c: Column) -> Column:
    return strip_edges(F.regexp_replace(F.translate(c, " İı", " Ii"), r"(?U)\s+", " "))


def merchant_name(c: Column) -> Column:
    """Canonical merchant: an alias whose key is contained, first in order; else the upper-case text without numbers of six digits or more."""
    up = strip_edges(F.regexp_replace(collapse(F.upper(merchant_cleaned(c))), r"\s*-\s*", "-"))
    rest = F.trim(F.regexp_replace(F.regexp_replace(up, r"\b\d{6,}\b", " "), r"\s+", " "))
    out = None
    for key, name in fixed.MERCHANT_ALIASES.items():
        out = F.when(F.contains(up, F.lit(key)), name) if out is None else out.when(F.contains(up, F.lit(key)), name)
    return out.otherwise(rest)


def merchant_confidence(raw: Column, name: Column) -> Column:
    score = F.lit(0.60) + F.when(F.length(name) >= 3, 0.20).otherwise(0.0) + F.when(name.rlike(r"\p{L}"), 0.10).otherwise(0.0) + F.when(name.isin(*set(fixed.MERCHANT_ALIASES.values())), 0.10).otherwise(0.0)
    return F.when((F.coalesce(raw, F.lit("")) == "") | (merchant_cleaned(raw) == "") | (name == ""), 0.20).otherwise(F.round(F.least(score, F.lit(0.98)), 4))


def merchant_text(c: Column) -> Column:
    """What categorisation reads: lower case, without noise words, numbers and marks; the lower-case text if nothing is left."""
    low = F.lower(c)
    words = "|".join(fixed.MERCHANT_NOISE)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, rf"(?U)\b(?:{words})\b", " "), r"\d{2,}", " "), r"[*/_|#:;.,()\[\]]+", " ")
    return F.coalesce(F.nullif(collapse(t), F.lit("")), F.trim(low))


def intent(c: Column) -> Column:
    def first(low: Column) -> Column:
        out = None
        for name, words in fixed.INTENTS:
            out = F.when(contains_any(low, words), name) if out is None else out.when(contains_any(low, words), name)
        return out.otherwise("general_statement_question")

    return F.transform(F.array(F.lower(c)), first)[0]
