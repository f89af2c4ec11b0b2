"""Personal data: values found and validated, then replaced by format-preserving Feistel pseudonyms.

A pseudonym has the format of its value and is a keyed permutation within that format: a card number
gives a number of as many digits with a right check digit, a date a date, an address four bytes.
Equal values give equal pseudonyms in every document, whatever separators they are written with, and
who holds the key can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import kept_by_worker

ROUNDS = 8
KEY = b"a key that is not a secret: pass your own"
DAY_0, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31
# Ten digits that can be a number of the North American plan: area and exchange begin with 2 to 9.
NATIONAL = re.compile(r"[2-9]\d\d[2-9]\d{6}")


class Feistel:
    """A keyed permutation of 0..size-1 per tweak: an unbalanced Feistel network over the least square
    of numbers that covers the size, walked until the result is in range."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key).digest()[:32], rounds

    def function(self, tweak: str, i: int, half: int) -> int:
        data = f"{tweak}/{i}/{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest())

    def once(self, tweak: str, size: int, value: int, back: bool) -> int:
        side = 1
        while side * side < size:
            side *= 2
        left, right = divmod(value, side)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = (right - self.function(tweak, i, left)) % side, left
            else:
                left, right = right, (left + self.function(tweak, i, right)) % side
        return left * side + right

    def permute(self, tweak: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        value = self.once(tweak, size, value, back)
        while value >= size:
            value = self.once(tweak, size, value, back)
        return value


def check_digit(digits: str) -> str:
    """The last digit that makes the sum of digits, every second one doubled from the right, a multiple of ten."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    total = sum(doubled[int(d)] if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def date_class(day: datetime.date) -> tuple[int, bool]:
    """What the way a date is written may depend on: whether day and month take one digit, and whether
    the day could be a month. Dates permute inside a class, so a pseudonym is read as its value was."""
    return (0 if day.day < 10 else 1 if day.day <= 12 else 2), day.month < 10


def dates_by_class() -> dict[tuple[int, bool], dict[int, int]]:
    """Per class its days, each with its place."""
    return kept_by_worker("dates by class", _dates_by_class)


def _dates_by_class() -> dict[tuple[int, bool], dict[int, int]]:
    classes: dict[tuple[int, bool], dict[int, int]] = {}
    for number in range(DAY_0, DAY_0 + DAYS):
        members = classes.setdefault(date_class(datetime.date.fromordinal(number)), {})
        members[number] = len(members)
    return classes


def days_of(name: tuple[int, bool]) -> list[int]:
    return kept_by_worker(f"days of {name}", lambda: list(dates_by_class()[name]))


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and check_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def spread(template: str, characters: str, fits: Callable[[str], bool]) -> str:
    """`template` with its characters that fit replaced, in order; the others stay in their places."""
    new = iter(characters)
    return "".join(next(new) if fits(c) else c for c in template)


class Pseudonyms:
    """One method per format: a found value to its pseudonym, or None where it is not valid in the format."""

    def __init__(self, key: bytes = KEY, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def digits(self, tweak: str, text: str) -> str:
        number = self.feistel.permute(f"{tweak}{len(text)}", 10 ** len(text), int(text), self.back)
        return str(number).zfill(len(text))

    def letters(self, tweak: str, text: str, alphabet: str) -> str:
        value = 0
        for c in text:
            value = value * len(alphabet) + alphabet.index(c)
        value = self.feistel.permute(f"{tweak}{len(text)}", len(alphabet) ** len(text), value, self.back)
        out = []
        for _ in text:
            value, at = divmod(value, len(alphabet))
            out.append(alphabet[at])
        return "".join(reversed(out))

    def card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not is_card(digits):
            return None
        body = self.digits("card", digits[:-1])
        return spread(found, body + check_digit(body), str.isdigit)

    def local(self, digits: str) -> str:
        """The last ten digits of a number: those that can stand without separators permute among themselves,
        the others too."""
        area, exchange, rest = int(digits[0]), int(digits[3]), int(digits[1:3] + digits[4:])
        if NATIONAL.fullmatch(digits):
            value = self.feistel.permute("phone", 64 * 10**8, ((area - 2) * 8 + exchange - 2) * 10**8 + rest, self.back)
            first, rest = divmod(value, 10**8)
            area, exchange = first // 8 + 2, first % 8 + 2
        else:
            pairs = [(a, e) for a in range(10) for e in range(10) if a < 2 or e < 2]
            value = self.feistel.permute("phone-other", len(pairs) * 10**8, pairs.index((area, exchange)) * 10**8 + rest, self.back)
            first, rest = divmod(value, 10**8)
            area, exchange = pairs[first]
        tail = f"{rest:08d}"
        return f"{area}{tail[:2]}{exchange}{tail[2:]}"

    def phone(self, found: str) -> str | None:
        """What is before the last ten digits stays; of a shorter international number the first three."""
        digits = re.sub(r"\D", "", found)
        if not (8 if found[0] == "+" else 10) <= len(digits) <= 15:
            return None
        new = digits[:-10] + self.local(digits[-10:]) if len(digits) > 10 or found[0] != "+" else digits[:3] + self.digits("phone", digits[3:])
        return spread(found, new, str.isdigit)

    def social(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        # The valid ones are numbered: 898 areas, 99 groups, 9999 serials.
        areas = [a for a in range(1, 900) if a != 666]
        value = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        value = self.feistel.permute("social", 898 * 99 * 9999, value, self.back)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return spread(found, f"{areas[area]:03d}{group + 1:02d}{serial + 1:04d}", str.isdigit)

    def address(self, found: str) -> str | None:
        parts = [int(p) for p in found.split(".")]
        if any(p > 255 for p in parts):
            return None
        value = self.feistel.permute("address", 1 << 32, int.from_bytes(bytes(parts)), self.back)
        return ".".join(str(p) for p in value.to_bytes(4))

    def date(self, found: str) -> str | None:
        """Year first; or year last, and then day first with points or where only that is a date, else month first."""
        parts = re.split(r"\D", found)
        order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0) if "." in found or int(parts[0]) > 12 else (2, 0, 1)
        try:
            value = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            if "." not in found or order == (0, 1, 2) or int(parts[1]) <= 12:
                return None
            # With points too, a month of more than twelve is the day.
            order = (2, 0, 1)
            try:
                value = datetime.date(*(int(parts[i]) for i in order))
            except ValueError:
                return None
        if not 0 <= value.toordinal() - DAY_0 < DAYS:
            return None
        name = date_class(value)
        members = days_of(name)
        at = self.feistel.permute(f"date{name}", len(members), dates_by_class()[name][value.toordinal()], self.back)
        new = datetime.date.fromordinal(members[at])
        written = dict(zip(order, (new.year, new.month, new.day)))
        return spread(found, "".join(f"{written[i]:0{len(part)}d}" for i, part in enumerate(parts)), str.isdigit)

    def account(self, found: str) -> str | None:
        """An international account number with right check digits: those behind the country permute."""
        packed = found.replace(" ", "").upper()
        rest = lambda body, country: 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 != 1:
            return None
        body = self.letters("account", packed[4:], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") if re.search("[A-Z]", packed[4:]) else self.digits("account", packed[4:])
        return spread(found, packed[:2] + f"{rest(body, packed[:2]):02d}" + body, str.isalnum)

    def mail(self, found: str) -> str | None:
        name, _, domain = found.lower().partition("@")
        # Runs of letters and of digits permute among those of their length; the host's last two labels stay.
        host, dot, kept = domain.rpartition("." + ".".join(domain.split(".")[-2:]))
        change = lambda text, tweak: re.sub(
            r"[a-z]+|[0-9]+", lambda m: self.letters(tweak, m[0], "abcdefghijklmnopqrstuvwxyz") if m[0][0].isalpha() else self.digits(tweak, m[0]), text)
        return f"{change(name, 'mail')}@{change(host, 'host')}{dot}{kept}"

    def key_id(self, found: str) -> str | None:
        return found[:4] + self.letters("keyid", found[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def secret(self, found: str) -> str | None:
        return self.letters("secret", found, "0123456789abcdef")


# What is looked for, in order of precedence where two begin at the same place; cards in what is then left.
PATTERNS = {
    "mail": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key_id": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=[=:\"' ])(?<![0-9a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{40}|(?<=password=)[0-9a-f]{12,64}|[0-9a-f]{32}|[0-9a-f]{64})(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:(?:19|20)\d\d(?P<sep>[-/.])\d\d(?P=sep)\d\d|\d{1,2}(?P<by>[-/.])\d{1,2}(?P=by)(?:19|20)\d\d)(?![\d]|[-/.]\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+[1-9]\d{7,14}(?!\d)"
             r"|\+[1-9]\d{0,6}(?:(?:[ .-]|[ .-]?\(\d{1,4}\)[ .-]?)\d{1,14}){1,6}(?!\d)|(?<!\d[.,-])[2-9]\d\d[2-9]\d{6}(?!\w|[.,-]\d))",
}
EACH = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
KINDS = tuple(PATTERNS)
RUN, GROUP = re.compile(r"(?<!\d)(?<!\d\.)\d(?:[ -]?\d){12,}"), re.compile(r"\d+")
WAYS = ((4, 4, 4, 4), (4, 6, 5))  # how cards are grouped
REMEMBERED = 200_000


def cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the cards are between two places: of neighbouring groups of digits, any that together are a card.

    Of those that overlap, one unbroken group goes first, then the usual ways of grouping, then the longest:
    what is beside a card, such as its expiry or code, mostly does not decide what is taken for it.
    """
    for run in RUN.finditer(text, start, end):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        tried = []
        for i in range(len(groups)):
            sizes: list[int] = []
            for a, b in groups[i:i + 19]:
                sizes.append(b - a)
                if sum(sizes) > 19:
                    break
                if sum(sizes) >= 13:
                    usual = tuple(sizes) in WAYS and len(set(re.findall(r"[ -]", text[groups[i][0]:b]))) == 1
                    rank = 0 if len(sizes) == 1 else 1 if usual else 2
                    tried.append((rank, -sum(sizes), i, i + len(sizes)))
        taken: set[int] = set()
        for _, _, i, j in sorted(tried):
            a, b = groups[i][0], groups[j - 1][1]
            if taken.isdisjoint(range(i, j)) and is_card(re.sub(r"\D", "", text[a:b])):
                taken.update(range(i, j))
                yield a, b


def shorter(kind: str, found: str) -> Iterator[str]:
    """What is to be tried for a match: itself, and a number of a country without its last groups."""
    yield found
    while kind == "phone" and found[0] == "+" and (cut := re.search(r"[ .()-]+\d+$", found)):
        found = found[:cut.start()]
        yield found


def scrubber(key: bytes, back: bool = False) -> Callable[[str], tuple[str, list[tuple[str, int, int]]]]:
    """text -> (text with pseudonyms, [(kind, start, length) of each]), with a memory of values."""
    names, known = Pseudonyms(key, back), {}

    def pseudonym(kind: str, found: str) -> str | None:
        if (kind, found) not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[kind, found] = getattr(names, kind)(found)
        return known[kind, found]

    def at(text: str, match: re.Match) -> tuple[str, int, str, str] | None:
        """The first kind that has a valid value where a match begins: kind, start, value, pseudonym."""
        start = match.start()
        for kind in KINDS[KINDS.index(match.lastgroup):]:
            own = match if kind == match.lastgroup else EACH[kind].match(text, start)
            for found in shorter(kind, own[0]) if own else ():
                if (new := pseudonym(kind, found)) is not None:
                    return kind, start, found, new
        return None

    def scrub(text: str) -> tuple[str, list[tuple[str, int, int]]]:
        values, place, upto = [], 0, 0
        # What is not valid is passed by one character only: something else may begin inside.
        while match := ANY.search(text, place):
            value = at(text, match)
            place = match.start() + 1
            if value is not None:
                values += [("card", a, text[a:b], pseudonym("card", text[a:b])) for a, b in cards(text, upto, value[1])]
                values.append(value)
                place = upto = value[1] + len(value[2])
        values += [("card", a, text[a:b], pseudonym("card", text[a:b])) for a, b in cards(text, upto, len(text))]
        out, upto = [], 0
        for _, start, found, new in sorted(values, key=lambda v: v[1]):
            out += [text[upto:start], new]
            upto = start + len(found)
        return "".join([*out, text[upto:]]), [(kind, start, len(found)) for kind, start, found, _ in sorted(values, key=lambda v: v[1])]

    return scrub


SPANS = "array<struct<kind: string, start: int, length: int>>"


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """doc_id, text, n_found and spans (kind, start, length in the input) of every row of `docs`.

    Values that look like a format but are not valid in it, such as a card number with a wrong check
    digit, stay. Dates are written year first, day first or month first; where both may be meant, with points the day
    is first. Phones are those of ten digits with or without separators, and any with a plus. Null texts stay null, with nothing found; texts without a digit or an @ stay
    as they are. Texts are read whole; repeated rows get the same result each; an empty table gives
    no row. With `back` and the same key the values found are turned back; a card that overlaps other digits in
    no usual grouping may then be taken for another one in one of ten cases.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scrub = scrubber(key, back)
        may = re.compile(r"[\d@]|A[KS]IA")
        for batch in batches:
            results = [scrub(text) if text is not None and may.search(text) else (text, []) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text": [r[0] for r in results], "n_found": [len(r[1]) for r in results],
                "spans": [[dict(zip(("kind", "start", "length"), s)) for s in r[1]] for r in results]})

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInPandas(work, f"doc_id bigint, text string, n_found int, spans {SPANS}")

