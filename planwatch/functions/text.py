"""Texts of price tables as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stay small inside a name, and short forms that stay as they are.
PARTICLES = ("de", "da", "do", "das", "dos", "e", "em")
SHORT_FORMS = ("SA", "S.A.", "S/A", "LTDA", "ME", "EIRELI", "UTI", "SUS")
#: Where a band starts and the end that a range must state.
BAND_ENDS = {0: 18, 19: 23, 24: 28, 29: 33, 34: 38, 39: 43, 44: 48, 49: 53, 54: 58}
#: What says "and more" behind the last band's first age, or before it.
MORE_BEHIND = (("+",), (">",), ("ou", "mais"), ("ou", "+"), ("ou", "acima"), ("em", "diante"), ("e", "acima"), ("acima",))
MORE_BEFORE = (("acima",), ("a", "partir"), ("+",), ("mais",), (">",), (">", "="), ("≥",))
#: Months by name, as they begin.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, to nothing, or to several, by Unicode's compatibility decomposition without its marks."""
    one, several = {"–": "-", "—": "-"}, {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2150), *range(0xFB00, 0xFB07)]):
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if to != c and c not in one:
            (one if len(to) == 1 else several)[c] = to
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one) + marks, "".join(one.values()), several


_FROM, _TO, _SEVERAL = _foldings()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f names it: Spark writes a column's whole expression wherever it is named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case, dashes as '-', letters without accents, ligatures and odd spaces as plain ones.

    Only the different characters outside ASCII of a text are looked up, each once; a text without them is done when it is in lower case."""
    several = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    plain = lambda c: F.coalesce(F.try_element_at(several, c), F.translate(c, _FROM, _TO))
    odd = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    folded = lambda x: F.aggregate(odd(x), x, lambda t, c: F.replace(t, c, plain(c)))
    return let(F.lower(text), lambda x: F.when(F.octet_length(x) == F.char_length(x), x).otherwise(folded(x)))


def unescaped(text: Column) -> Column:
    """``text`` with its HTML entities decoded, named ones and numbers; what names no character stays."""
    entity = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    letter = lambda code: F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    def decoded(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).cast("bigint")
        return F.coalesce(F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), letter(F.hex(number))), F.try_element_at(names, name), F.concat(F.lit("&"), name, F.lit(";")))

    found = F.regexp_extract_all(text, F.lit(entity), F.lit(1))
    whole = let(found, lambda names_: F.array_join(F.transform(F.split(text, entity, -1), lambda piece, i: F.concat(piece, F.coalesce(let(F.get(names_, i), decoded), F.lit("")))), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def tokens(text: Column) -> Column:
    """The words, numbers and signs of a folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[a-z]+|[0-9]+|[^\sa-z0-9]"), F.lit(0))


def _begins(words: Column, start: tuple[str, ...], at: int = 0) -> Column:
    c = F.lit(True)
    for i, w in enumerate(start):
        c = c & F.coalesce(F.get(words, F.lit(at + i)) == w, F.lit(False))
    return c


def _any(conditions: list[Column]) -> Column:
    c = F.lit(False)
    for x in conditions:
        c = c | x
    return c


def money(text: Column) -> Column:
    """'1.065,14' as decimal(12,2); null for what isn't such an amount."""
    plain = F.translate(text, ".,", "\0.")
    return F.when(text.rlike(r"^\d{1,3}(\.\d{3})*,\d{2}$"), F.replace(plain, F.lit("\0"), F.lit("")).cast("decimal(12,2)"))


def without_currency(text: Column) -> Column:
    """An amount without the currency in front and the signs that a scan puts behind it: 'R$:490,57' is '490,57'."""
    t = F.trim(text)
    return F.when(t.startswith("R$"), F.regexp_replace(F.substr(t, F.lit(3)), r"^[^\p{L}\p{N}_]*", "")).otherwise(t)


def written_registration(text: Column) -> Column:
    """The nine digits of a registration that a text holds as ddd.ddd/dd-d; null without one."""
    written = F.regexp_extract(text, r"\b(\d{3}\.?\d{3}/\d{2}-?\d)\b", 1)
    return F.when(written != "", F.regexp_replace(written, r"\D", ""))


def registration(text: Column) -> Column:
    """The nine digits of a product's registration, written ddd.ddd/dd-d or not; null without them."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.coalesce(written_registration(text), F.when(F.length(digits) == 9, digits))


def formatted_registration(number: Column) -> Column:
    return F.when(F.length(number) == 9, F.regexp_replace(number, r"^(.{3})(.{3})(.{2})(.)$", "$1.$2/$3-$4")).otherwise(number)


def band_of_label(label: Column) -> Column:
    """The band 0..9 that a label names: '19 a 23', 'até 18', '59 ou mais', '> 59 anos'; null for any other text.

    A label is read as words, numbers and signs without units: a range must state the end that its start has by law; the last band is its
    first age alone, or with a sign or words for "and more" on either side.
    """
    words = F.filter(tokens(unescaped(label)), lambda w: ~w.isin("de", "ano", "anos", "/"))
    return let(words, _band_of_words)


def _band_of_words(words: Column) -> Column:
    word = lambda i: F.get(words, F.lit(i))
    number = lambda i: F.when(word(i).rlike("^[0-9]{1,2}$"), word(i).cast("int"))
    ranged = number(0).isNotNull() & word(1).isin("a", "-", "ate") & word(2).rlike("^[0-9]{2}$")
    lawful = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(BAND_ENDS.items()) for x in (100 * a + b, i)])
    behind = _begins(words, ("59",)) & ((F.size(words) == 1) | _any([_begins(words, m, 1) for m in MORE_BEHIND]))
    before = _any([_begins(words, (*m, "59")) for m in MORE_BEFORE])
    return F.when(F.coalesce(ranged, F.lit(False)), F.try_element_at(lawful, 100 * number(0) + number(2))).when(behind | before, F.lit(9)).when(_begins(words, ("ate", "18")), F.lit(0))


def proper_name(text: Column) -> Column:
    """Each word with a capital; particles small except in front, short forms as they are."""

    def word(w: Column, i: Column) -> Column:
        return F.when(w.isin(*SHORT_FORMS), w).when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), word), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def normalized(text: Column) -> Column:
    """Lower case, white space as single blanks: what tells labels apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def original_url(url: Column) -> Column:
    """The address a copy in a web archive was made of, or the address itself: what stands behind the archive's host, ``web`` and a time stamp."""

    def of(steps):  # scheme, nothing, host, web, stamp, and the address that was copied
        step = lambda i: F.coalesce(F.get(steps, F.lit(i)), F.lit(""))
        stamp = F.translate(F.lower(step(4)), "abcdefghijklmnopqrstuvwxyz_", "")
        copy = F.lower(step(0)).isin("http:", "https:") & (F.lower(step(2)) == "web.archive.org") & (F.lower(step(3)) == "web") & F.length(stamp).between(1, 14) & step(4).startswith(stamp) & (F.translate(stamp, "0123456789", "") == "")
        whole = F.lower(step(5)).isin("http:", "https:") & (F.size(steps) > 7)
        return F.array_join(F.when(copy & whole, F.slice(steps, 6, F.greatest(F.size(steps) - 5, F.lit(0)))).otherwise(steps), "/")

    return let(F.split(url, "/"), of)


#: How a date stands at the end of a file's name: the order of day, month and year (s: two digits of it), and what parts them; - may be left out.
DATED_NAMES = (("dmy", "_-"), ("ymd", "-"))


def _dated_end(path: Column, order: str, between: str) -> Column:
    """(digits, length) of the date at the end of a name, before .pdf: its groups of digits in order, and how much of the name it takes with the sign before
    it; null without one. Groups that are parted are as long as their part of the date, those that aren't are one."""
    widths = [4 if x == "y" else 2 for x in order]
    n, total = len(order), sum(widths)

    def of(tail):
        return let(F.split(tail, "[_-]"), lambda groups: told(tail, groups))

    def told(tail, groups):
        group = lambda back: F.coalesce(F.get(groups, F.size(groups) - back), F.lit(""))
        parted = F.size(groups) > n
        for k, width in enumerate(widths):
            parted = parted & (F.length(group(n - k)) == width)
        if "_" not in between:
            parted = parted & ~F.contains(F.right(tail, F.lit(total + n - 1)), F.lit("_"))
        joined = (F.size(groups) > 1) & (F.length(group(1)) == total) & F.lit(between == "-")
        one = lambda digits, length: F.struct(digits.alias("digits"), F.lit(length).alias("length"))
        found = F.when(parted, one(F.concat(*[group(n - k) for k in range(n)]), total + n)).when(joined, one(group(1), total + 1))
        return let(found, lambda f: F.when(F.substring(f["digits"], sum(widths[: order.index("y")]) + 1, 2) == "20", f)) if "y" in order else found

    stem = F.when(F.lower(path).endswith(".pdf"), F.left(path, F.length(path) - 4))
    return let(F.regexp_extract(stem, "[0-9_-]+$", 0), of)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def series_key(url: Column, forms: tuple = DATED_NAMES) -> Column:
    """What stays the same from one version of a file to the next: host without www and port, lower-case path without the date of its name."""
    u = original_url(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    path = _path(u)
    for form in forms:
        def without(p, form=form):
            return let(_dated_end(p, *form), lambda end: F.when(end.isNotNull(), F.concat(F.left(p, F.length(p) - 4 - end["length"]), F.right(p, F.lit(4)))).otherwise(p))

        path = let(path, lambda p: without(p))
    return F.concat(host, F.lower(path))


def date_in_name(url: Column, forms: tuple = DATED_NAMES) -> Column:
    """The date at the end of a file's name by the first of ``forms`` that fits; the first of the month where a form has no day; null
    without one, or for one that doesn't exist."""
    path, found = _path(original_url(url)), []
    for order, between in forms:
        spans, at = {}, 1
        for x in order:
            spans[x] = (at, 4 if x == "y" else 2)
            at += spans[x][1]

        def dated(digits, spans=spans):
            part = {x: F.substring(digits, *span) for x, span in spans.items()}
            year = part["y"] if "y" in part else F.concat(F.lit("20"), part["s"])
            return F.try_to_date(F.concat(year, F.lit("-"), part["m"], F.lit("-"), part.get("d", F.lit("01"))), "yyyy-MM-dd")

        found.append(let(_dated_end(path, order, between)["digits"], lambda digits: dated(digits)))
    return F.coalesce(*found)


def series_of_name(name: Column) -> Column:
    """The series that an uploaded file belongs to by its name: without .pdf, an archive's prefix, and a date at its end."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "^wayback_", "")
    return F.regexp_replace(bare, r"_[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "")


def file_name(url: Column) -> Column:
    """The last part of the path, decoded, with .pdf at its end."""
    name = F.url_decode(F.replace(F.element_at(F.split(_path(original_url(url)), "/"), -1), F.lit("+"), F.lit("%2B")))
    name = F.when(name == "", F.lit("material.pdf")).otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def safe_url(url: Column) -> Column:
    """An address as a browser asks for it: blanks and letters outside ASCII as escapes, what is an escape already stays."""
    odd = r"[^A-Za-z0-9/%:@!$&'()*+,;=\-._~?#\[\]]"
    found = F.regexp_extract_all(url, F.lit(odd), F.lit(0))
    escape = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(F.split(url, odd, -1), lambda piece, i: F.concat(piece, F.coalesce(escape(F.get(found, i)), F.lit("")))), "")


#: Words that announce a validity, in folded text, the characters that may part one from its date, and what joins two dates.
ANNOUNCED = ("vigencia", "vigente", "a partir de", "valido de", "valido a partir de", "valido para", "valido ate", "valida de", "valida a partir de", "valida para", "valida ate", "validos de", "validos a partir de", "validos para", "validos ate", "validas de", "validas a partir de", "validas para", "validas ate")
APART = 25
JOINED = ("a", "ate", "-")


def _as_date(written: Column, last: bool) -> Column:
    parts = F.split(written, "/")
    month = F.try_to_date(F.concat(F.lit("1/"), written), "d/M/yyyy")
    return F.when(F.size(parts) == 3, F.try_to_date(written, "d/M/yyyy")).when(F.size(parts) == 2, F.last_day(month) if last else month)


def _dates_of(folded: Column) -> Column:
    """The dates of a text, as words of digits parted by slashes, each with what stands before it since the one before."""
    shape = r"(?:\d\d?/){1,2}\d{4}"
    found, around = F.regexp_extract_all(folded, F.lit(shape), F.lit(0)), F.split(folded, shape)
    return F.zip_with(found, F.slice(around, F.lit(1), F.size(around) - 1), lambda d, b: F.struct(d.alias("date"), b.alias("before")))


def validity(text: Column, last: bool = False) -> Column:
    """The start (or the end) of the validity that a line states: dd/mm/yyyy, or mm/yyyy for the first or last day of a month. A date counts if few other characters,
    none a digit and blanks counted as one, part it from words that announce it; the end is a date that a word joins to it."""

    def announced(before):
        return let(F.concat(F.lit(" "), F.regexp_replace(F.regexp_extract(before, "[^0-9]*$", 0), "[^a-z]+", " ")), close)

    def close(near):
        return F.exists(F.array(*map(F.lit, ANNOUNCED)), lambda w: F.contains(near, F.concat(F.lit(" "), w)) & (F.length(F.element_at(F.split(near, F.concat(F.lit(" "), w)), -1)) <= APART))

    def stated(dates):
        at = F.array_position(F.transform(dates, lambda d: announced(d["before"])), F.lit(True)).cast("int")
        start, following = F.get(dates, at - 1), F.get(dates, at)
        if not last:
            return F.when(at > 0, _as_date(start["date"], False))
        return F.when((at > 0) & F.trim(following["before"]).isin(*JOINED), _as_date(following["date"], True))

    return let(let(fold(text), _dates_of), stated)


def stated_period(text: Column) -> Column:
    """(starts, ends) of a material's validity: its first two dates dd/mm/yyyy, else its first two with the month by name, as '01 de junho/26'; both null without
    two of a kind. A date that doesn't exist is null."""

    def figures(dates):
        whole = F.filter(dates, lambda d: F.size(F.split(d["date"], "/")) == 3)
        return F.transform(whole, lambda d: F.try_to_date(d["date"], "d/M/yyyy"))

    def named(words):
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: (F.get(words, i + 1) == "de") & F.get(words, i).rlike("^[0-9]{1,2}$") & F.get(words, i + 2).rlike("^[a-z]{3,}/[0-9]{2}"))
        return F.transform(at, lambda i: dated(F.get(words, i), F.split(F.get(words, i + 2), "/")))

    def dated(day, month):
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(month[0], F.lit(3)))
        return F.try_to_date(F.concat_ws("-", F.concat(F.lit("20"), F.left(month[1], F.lit(2))), number.cast("string"), day), "yyyy-M-d")

    def both(folded):
        return let(figures(_dates_of(folded)), lambda d: F.when(F.size(d) >= 2, d).otherwise(let(F.split(F.trim(folded), r"\s+"), named)))

    ends = let(let(fold(text), both), lambda d: F.when(F.size(d) >= 2, F.slice(d, 1, 2)))
    return F.struct(F.get(ends, F.lit(0)).alias("starts"), F.get(ends, F.lit(1)).alias("ends"))


def month_by_name(text: Column) -> Column:
    """The first day of a month that is written out: 'setembro de 2026', 'set/26'; null without one."""
    found = lambda i: F.regexp_extract(fold(text), r"\b(" + "|".join(MONTHS) + r")[a-z]*\.?\s*(?:de|/|-)?\s*(20[0-9]{2}|[0-9]{2})\b", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), found(1))
    year = F.when(F.length(found(2)) == 2, F.concat(F.lit("20"), found(2))).otherwise(found(2))
    return F.when(found(1) != "", F.try_to_date(F.concat_ws("-", year, month.cast("string")), "yyyy-M"))


def iso_date(text: Column) -> Column:
    """A date in ISO form; null for any other text."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def written_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def written_percent(ratio: Column) -> Column:
    """A ratio as '+12,3%'."""
    return F.replace(F.format_string("%+.1f%%", ratio * 100), F.lit("."), F.lit(","))
