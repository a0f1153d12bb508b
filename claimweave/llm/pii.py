"""PII: detected entities get keyed surrogates of the same type and format, distinct and the same everywhere."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, key_to_id, materialize, release, scratch

_UP, _LOW = "A-ZÀ-ÖØ-ÞЁА-Я", "a-zß-öø-ÿёа-я"
#: One capitalised word, or several joined by hyphens or apostrophes.
_WORD = rf"(?:[DO]['’])?[{_UP}][{_LOW}]++(?:[-'’][{_UP}][{_LOW}]++)*+"
#: Patterns by type, in order of precedence where two overlap. All quantifiers that could meet long runs are possessive or
#: bounded and start at the left edge of a run, so a text is read in linear time.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9À-ɏЀ-ӿ._%+\-])[A-Za-z0-9À-ɏЀ-ӿ._%+\-]++@[A-Za-z0-9À-ɏЀ-ӿ\-]{1,63}+(?:\.[A-Za-z0-9À-ɏЀ-ӿ\-]{1,63}+){1,8}+(?![A-Za-z0-9À-ɏЀ-ӿ\-])"),
    ("secret", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|rk)-(?:[a-z]{2,8}-)?[A-Za-z0-9_\-]{20,200}+|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,80}+)(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?<![a-z0-9])(?:[a-z]{1,12}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key))[\"']?\s{0,8}[:=]\s{0,8}[\"']?([A-Za-z0-9+/_.~!@#$%^&*\-]{8,256}+)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]{0,4}\d)"),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]{6,39}+(?![\w:]))(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}"),
    ("phone", r"(?<![\w+])(?:\+|00)(?=[1-9])\d{1,3}[ \-]?(?:\(\d{1,4}\)[ \-]?)?\d{1,4}(?:[ \-]\d{2,8}){1,4}(?!\d)|(?<![\w+])\+[1-9]\d{9,13}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w\-])[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\w+./\-])0[1-9]\d{1,3}[ /\-]\d{6,8}(?![\d\-/])"),
    ("card", r"(?<![\d\-])3[47]\d{2}([ \-]?)\d{6}\1\d{5}(?![\d\-])"),
    ("card", r"(?<![\d\-])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?![\d\-])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
)
_FINDERS = [(kind, re.compile(p)) for kind, p in PATTERNS]
#: A text without any of these characters or words holds no entity of the type.
_NEEDS = {"email": re.compile("@"), "secret": re.compile("(?i)token|secret|pass|pwd|api|A[KS]IA|k-|gh[pousr]_|xox"), "iban": re.compile(r"[A-Z]{2}\d{2}"), "ip": re.compile(r"\d\.\d"), "ipv6": re.compile(":[0-9A-Fa-f:]"), "phone": re.compile(r"[+0(\d-]\d{2}"), "card": re.compile(r"\d{4}"), "ssn": re.compile(r"\d-\d")}
#: Titles before names, by gender ("" says nothing on it) (fixed values).
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Г-жа": "f", "Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Г-н": "m", "Dr": "", "Prof": ""}
#: Words between a given and a family name that stay as they are (fixed values).
PARTICLES = "van von der den de du di da del la le zu zur ter ten".split()
_TITLED = re.compile(rf"(?<![\w-])({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?:(?:Dr|Prof)\.? )*((?:{_WORD} (?:[{_UP}]\. )?)?)(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}({_WORD})")
_NAMED = re.compile(rf"(?<![\w-]){_WORD}(?![\w-])")
_GIVEN_BEFORE = re.compile(rf"({_WORD}) (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}$")
#: Calling codes of one and of two digits; all others have three (fixed values).
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Given and family names of surrogates, by script and gender; and syllables of further ones (fixed values).
GIVEN = {
    ("latin", "f"): "Alba Berta Carla Dora Edda Flora Greta Hanna Ida Julia Klara Lena Mara Nora Olga Paula Rita Sara Tilda Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Otto Peter Ralf Simon Theo Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Мария Нина Ольга София".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
}
FAMILY = {
    "latin": "Abel Brandt Conrad Daly Ebert Falk Garner Hale Ingram Jansen Keller Lorenz Marten Norden Osten Palmer Quast Reimer Sander Thorne".split(),
    "cyrillic": "Андреев Белов Волков Громов Дроздов Ершов Жуков Зайцев".split(),
}
SYLLABLES = {"latin": ("b d f g h k l m n p r s t v".split(), "a e i o u".split(), ("l", "n", "r", "s", "")), "cyrillic": ("б в г д з к л м н п р с т".split(), "а е и о у".split(), ("л", "н", "р", "с", ""))}
#: Ranges of addresses that stay among themselves, as (first octets, number of fixed octets); others are public (fixed values).
LOCAL_NETS = (((10,), 1), ((127,), 1), ((192, 168), 2), ((169, 254), 2), *(((172, k), 2) for k in range(16, 32)))
#: A space of which the corpus uses more than an eighth is permuted within itself; else surrogates are no real values of the corpus.
DENSE = 8
#: Beginnings of keys that tell what they are for (fixed values).
KEY_HEADS = re.compile(r"(?:AKIA|ASIA|(?:sk|pk|rk)-(?:[a-z]{2,8}-)?|gh[pousr]_|xox[abprs]-)")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _script(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "latin"


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Given and family names: after titles, and wherever a text has a family name again that it has after a title.

    A given name is an entity of its own, and so is a family name; one family name is one entity whatever
    goes before it, so all forms of a person's name stay together. A Cyrillic family name has the gender of its ending.
    """
    known: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        known[m[3]] = known.get(m[3]) or TITLES[m[1]] or "m"
        if m[2]:
            yield m.start(2), m.start(2) + len(m[2].split(" ")[0]), f"given:{_script(m[2])}:{TITLES[m[1]] or 'm'}", m[2].split(" ")[0]
    if not known:
        return
    for m in _NAMED.finditer(text):
        if m[0] not in known:
            continue
        script = _script(m[0])
        gender = known[m[0]]
        yield m.start(), m.end(), f"family:{script}" + (f":{'f' if m[0][-1] in 'ая' else 'm'}" if script == "cyrillic" else ""), m[0]
        given = _GIVEN_BEFORE.search(text, max(0, m.start() - 40), m.start())
        if given and given[1] not in TITLES and given[1] not in known and (given.start() == 0 or text[given.start() - 1] not in ".!?\n" and text[max(0, given.start() - 2)] not in ".!?\n"):
            yield given.start(1), given.end(1), f"given:{_script(given[1])}:{gender}", given[1]


def _value(kind: str, raw: str) -> str | None:
    """What the same entity has in common wherever it occurs; None if this is none."""
    if kind == "email":
        local, _, domain = raw.rpartition("@")
        return raw.lower() if re.search("[A-Za-z]{2}$", domain) and len(local) <= 256 else None
    if kind == "ip":
        return ".".join(str(int(p)) for p in raw.split("."))
    if kind == "iban":
        plain = raw.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_rest(plain) == 1 else None
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", raw)
        if kind == "card" and len(digits) == 15 and not luhn(digits):
            return None
        if kind == "phone":
            return ("+" + digits if raw.startswith("+") else "+" + digits[2:] if raw.startswith("00") else digits) if len(digits) >= 8 else None
        return digits
    if kind == "ipv6":
        try:
            return str(ipaddress.IPv6Address(raw)) if len(re.findall("[0-9A-Fa-f]+", raw)) >= 3 else None
        except ValueError:
            return None
    if kind == "secret":
        return raw if len(raw) >= 16 or re.search(r"\d", raw) else None
    return raw


def iban_rest(plain: str) -> int:
    """The remainder by 97 of an account number whose country and check digits stand at its end; 1 for a right one."""
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a whole text, in order and without overlap.

    The type of a name has its script and gender. The value is what the same entity has in common wherever it
    occurs: e-mail addresses in lower case, numbers without separators, phone numbers with ``+`` where the country is known.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = None

    def add(start: int, end: int, kind: str, value: str) -> None:
        nonlocal taken
        taken = bytearray(len(text)) if taken is None else taken
        if 1 not in taken[start:end]:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, value))

    for kind, finder in _FINDERS:
        if _NEEDS[kind].search(text):
            for m in finder.finditer(text):
                start, end = m.span(1) if kind == "secret" else m.span()
                value = _value(kind, text[start:end])
                if value is not None:
                    add(start, end, kind, value)
    for start, end, kind, value in _names(text):
        add(start, end, kind, value)
    return sorted(found)


def _stream(key: bytes, kind: str, value: str, attempt: int):
    """Endless keyed numbers below 2^32."""
    block = 0
    while True:
        seed = hmac.new(key, f"{kind}\0{value}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(seed[k : k + 4], "big") for k in range(0, 32, 4))
        block += 1


def country_code(number: str) -> str:
    """The calling code of a number that starts with ``+``, with the ``+``; empty for others."""
    if not number.startswith("+"):
        return ""
    return "+" + next((number[1 : 1 + n] for n in (1, 2) if number[1 : 1 + n] in CALLING_CODES), number[1:4])


def _syllables(draw, script: str, n: int) -> str:
    onset, vowel, coda = SYLLABLES[script]
    return "".join(onset[next(draw) % len(onset)] + vowel[next(draw) % len(vowel)] + coda[next(draw) % len(coda)] for _ in range(n)).capitalize()


def permuted(key: bytes, label: str, size: int, index: int, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse: a Feistel network that is walked until it ends within the range."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, name = (1 << half) - 1, hashlib.blake2b(label.encode(), key=key[:64], digest_size=16).digest()
    turn = lambda k, x: int.from_bytes(hashlib.blake2b(x.to_bytes(8, "big"), key=name, salt=bytes([k]), digest_size=8).digest(), "big") & mask
    while True:
        left, right = index >> half, index & mask
        for k in range(7, -1, -1) if back else range(8):
            left, right = (right ^ turn(k, left), left) if back else (right, left ^ turn(k, right))
        index = left << half | right
        if index < size:
            return index


class Space:
    """All values of a class of numbers or addresses, numbered: what a surrogate has in common with its value is the class.

    Classes are the network of a local address (others are public), country, length and leading zeros of a phone number, and length and check of a card.
    """

    def __init__(self, kind: str, value: str):
        self.kind, self.size = kind, 0
        if kind == "ip":
            parts = [int(p) for p in value.split(".")]
            keep = next((n for head, n in LOCAL_NETS if tuple(parts[:n]) == head), 0)
            self.head, self.size = parts[:keep], 256 ** (4 - keep)
            self.label = ".".join(map(str, self.head))
        elif kind in ("ssn", "card"):
            self.right = kind == "card" and luhn(value)
            self.length, self.size = len(value), 10 ** len(value) if kind == "ssn" else 10 ** (len(value) - 1) * (1 if self.right else 9)
            self.label = f"{self.length}:{self.right}"
        elif kind == "phone":
            self.code = country_code(value)
            rest = value[len(self.code) :]
            digits = len(rest.lstrip("0"))
            # numbers of few digits after many zeros are one class
            self.length, self.low = len(rest), 0 if digits < 5 else 10 ** (digits - 1)
            self.size = min(10**self.length, 10**4) if digits < 5 else 9 * self.low
            self.label = f"{self.code}:{self.length}:{self.low}"
        if self.size >= 2**62:
            self.size = 0

    def index(self, value: str) -> int:
        if self.kind == "ip":
            return int.from_bytes(bytes(int(p) for p in value.split(".")[len(self.head) :]), "big")
        if self.kind == "ssn":
            return int(value)
        if self.kind == "card":
            front, last = int(value[:-1]), int(value[-1])
            return front if self.right else front * 9 + (last - _check_digit(value[:-1])) % 10 - 1
        return int(value[len(self.code) :]) - self.low

    def value(self, index: int) -> str | None:
        """The value of a number; None if it is none of the class."""
        if self.kind == "ip":
            parts = [*self.head, *index.to_bytes(4 - len(self.head), "big")]
            local = any(tuple(parts[:n]) == head for head, n in LOCAL_NETS)
            return ".".join(map(str, parts)) if self.head or not local and 0 < parts[0] < 224 else None
        if self.kind == "ssn":
            return f"{index:0{self.length}d}"
        if self.kind == "card":
            front, step = (index, 0) if self.right else divmod(index, 9)
            front = f"{front:0{self.length - 1}d}"
            return front + str((_check_digit(front) + (0 if self.right else step + 1)) % 10)
        return self.code + f"{index + self.low:0{self.length}d}"

    def place(self, key: bytes, value: str) -> int:
        """Where a value stands in the keyed order of its class."""
        return permuted(key, f"{self.kind}:{self.label}", self.size, self.index(value))

    def after(self, key: bytes, place: int) -> tuple[int, str]:
        """The next place in the keyed order that holds a value of the class, and that value; the order is one circle."""
        while True:
            place = (place + 1) % self.size
            found = self.value(permuted(key, f"{self.kind}:{self.label}", self.size, place, back=True))
            if found is not None:
                return place, found


def _check_digit(front: str) -> int:
    return next(d for d in range(10) if luhn(f"{front}{d}"))


def surrogate_value(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """A drawn value that may stand for ``value``, for types whose values cannot run out: of the same type, length and character classes.

    E-mail addresses keep the shape of the local part and get a reserved domain, with ever more digits. Secrets get letters and
    digits, whatever they had; account numbers keep country and length and get right check digits.
    Names come from lists of their script and gender; by attempt they are made of more and more syllables instead, so
    names never run out.
    """
    draw = _stream(key, kind, value, attempt)
    if kind == "email":
        local = value.rpartition("@")[0]
        return "".join(_same_class(c, next(draw)) for c in local) + f".{next(draw) % 10 ** (6 + attempt // 4):0{6 + attempt // 4}d}@example.org"
    if kind == "ipv6":
        head, groups = (8, ["fe80"]) if value.startswith("fe80") else (8, ["fd00"]) if value[:2] in ("fc", "fd") else (8, ["2001", "db8"])
        return str(ipaddress.IPv6Address(":".join(groups + [f"{next(draw) % 0xFFFF + 1:x}" for _ in range(head - len(groups))])))
    if kind == "phone":
        head = country_code(value)
        return head + "".join(str(next(draw) % 10) for _ in value[len(head) :])
    if kind == "iban":
        body = "".join(_same_class(c, next(draw)) for c in value[4:])
        return value[:2] + f"{98 - iban_rest(value[:2] + '00' + body):02d}" + body
    if kind == "secret":
        head = KEY_HEADS.match(value)
        kept = head[0] if head else ""
        rest, hexa = value[len(kept) :], re.fullmatch("[0-9a-fA-F]+", value) is not None
        mixed = attempt >= 8
        return kept + "".join(LETTERS_DIGITS[next(draw) % 62] if mixed or not c.isalnum() else _same_class(c, next(draw), hexa) for c in rest)
    sort, script, *gender = kind.split(":")
    woman = gender == ["f"]
    if attempt < 4:
        names = FAMILY[script] if sort == "family" else GIVEN[script, gender[0]]
        name = names[next(draw) % len(names)]
    else:
        name = _syllables(draw, script, 2 + attempt // 4)
        if script == "cyrillic" and sort == "family":
            name += "ов"
        elif sort == "given" and woman:
            name = name.rstrip("lnrsлнрс") if name[-1] in "lnrsлнрс" else name
            name = name[:-1] + ("а" if script == "cyrillic" else "a")
    return name + "а" if script == "cyrillic" and sort == "family" and woman else name


LETTERS_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _same_class(c: str, n: int, hexa: bool = False) -> str:
    if c.isdigit():
        return str(n % 10)
    for letters in (("abcdef", "ABCDEF") if hexa else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")):
        if c in letters:
            return letters[n % len(letters)]
    return c


def format_like(original: str, kind: str, value: str) -> str:
    """The surrogate value with the separators of this occurrence."""
    if kind == "iban":
        signs = iter(value)
        return re.sub("[^ ]", lambda _: next(signs), original)
    if kind in ("phone", "card", "ssn"):
        digits = iter(value.lstrip("+"))
        lead = 2 if kind == "phone" and original.startswith("00") else 0
        return original[:lead] + re.sub(r"\d", lambda _: next(digits), original[lead:])
    if kind == "email" and original.isupper():
        return value.upper()
    return value


def _drawn(key: bytes) -> Column:
    @F.pandas_udf("string")
    def udf(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate_value(key, k, v, int(a)) for k, v, a in zip(kind, value, attempt)], dtype=object)

    return udf(F.col("kind"), F.col("value"), F.col("attempt"))


def _space(key: bytes) -> Column:
    """Struct (label, size, place) of a value's class and its place in it; size 0 where values are drawn instead."""

    @F.pandas_udf("label string, size long, place long")
    def udf(kind: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = []
        for k, v in zip(kind, value):
            space = Space(k, v) if k in NUMBERED else None
            rows.append((f"{k}:{space.label}", space.size, space.place(key, v)) if space and space.size else ("", 0, 0))
        return pd.DataFrame(rows, columns=["label", "size", "place"])

    return udf(F.col("kind"), F.col("value"))


def _step(key: bytes) -> Column:
    @F.pandas_udf("place long, surrogate string")
    def udf(kind: pd.Series, value: pd.Series, place: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Space(k, v).after(key, int(p)) for k, v, p in zip(kind, value, place)], columns=["place", "surrogate"])

    return udf(F.col("kind"), F.col("value"), F.col("place"))


NUMBERED = ("ip", "phone", "card", "ssn")


def _numbered_surrogates(spaced: DataFrame, key: bytes) -> list[DataFrame]:
    """Surrogates (kind, value, surrogate) from the keyed circles of classes (kind, value, label, size, place).

    Along a circle a value opens a bracket and a place without a value closes one; a value's surrogate is the place that closes its bracket. So no two share one, none is a
    real value of the corpus, and all brackets close, as at most an eighth of the places has values. Where more has (in classes of DENSE), a value's surrogate is the
    next place, perhaps a real value of another entity, but never its own. A round moves open brackets one place on, and reads and writes only these.
    """
    counts = spaced.groupBy("label").agg((F.count("*") * DENSE > F.first("size")).alias("dense"))
    real = spaced.select("label", "place", F.lit(True).alias("taken"))
    open_ = materialize(spaced.join(counts, "label").withColumn("depth", F.lit(1)), "open")
    done = []
    while not open_.isEmpty():
        moved = open_.select("kind", "value", "label", "dense", "depth", _step(key).alias("s")).select("kind", "value", "label", "dense", "depth", "s.*")
        met = moved.join(real, ["label", "place"], "left").withColumn("depth", F.when(F.col("dense"), 0).otherwise(F.col("depth") + F.when(F.col("taken"), 1).otherwise(-1))).drop("taken")
        now = materialize(met, "open")
        release(open_)
        done.append(now.where("depth = 0").select("kind", "value", "surrogate"))
        open_ = now.where("depth > 0").drop("surrogate")
        if not open_.isEmpty():
            open_ = materialize(open_, "open")
    return done


def _drawn_surrogates(open_: DataFrame, key: bytes) -> list[DataFrame]:
    """Surrogates (kind, value, surrogate) that are drawn until they are neither a real value nor another's: of several, the least value keeps it.

    Names, e-mail addresses and secrets grow with the rounds, account numbers and addresses of the new protocol cannot run out. A round reads what is given and
    writes what it gives and what stays open.
    """
    family = F.substring_index("kind", ":", 1)
    open_ = open_.select("kind", "value", F.lit(0).alias("attempt"))
    taken = materialize(open_.select(family.alias("family"), F.col("value").alias("surrogate")).distinct(), "real")
    done, attempt = [], 0
    while not open_.isEmpty():
        drawn = materialize(open_.withColumn("surrogate", _drawn(key)).withColumn("family", family), "drawn")
        owner = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("value", "kind")).alias("owner"))
        given = drawn.join(owner, ["family", "surrogate"]).where(F.col("owner") == F.struct("value", "kind")).drop("owner").join(taken, ["family", "surrogate"], "left_anti")
        now = materialize(given, "given")
        done.append(now.select("kind", "value", "surrogate"))
        taken = taken.unionByName(now.select("family", "surrogate"))
        attempt += 1
        open_ = drawn.join(now, ["kind", "value"], "left_anti").select("kind", "value", F.lit(attempt).alias("attempt"))
    return done


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, value, surrogate) for the distinct entities (kind, value); no two of a type share a surrogate, and none has its own value.

    Numbers and addresses take theirs from keyed orders of their classes, all others are drawn. No surrogate is a real value of its type in the corpus, but
    in classes of which the corpus uses more than an eighth (a local network, short phone numbers of a country).
    """
    spaced = materialize(entities.select("kind", "value").distinct().withColumn("s", _space(key)).select("kind", "value", "s.*"), "entities")
    done = [*_numbered_surrogates(spaced.where("size > 0"), key), *_drawn_surrogates(spaced.where("size = 0"), key)]
    out = spaced.limit(0).select("kind", "value", F.lit("").alias("surrogate"))
    for part in done:
        out = out.unionByName(part)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("key"), F.xxhash64("text").alias("tie"), "text")


def entity_rows(docs: DataFrame) -> DataFrame:
    """Rows (key, tie, kind, value): the distinct entities of each row of ``docs``; ``tie`` tells texts of one doc_id apart."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, tie, kind, value) for k, tie, t in zip(pdf["key"], pdf["tie"], pdf["text"]) for kind, value in sorted({e[2:] for e in find_entities(t)})]
            yield pd.DataFrame(rows, columns=["key", "tie", "kind", "value"])

    return _texts(docs).mapInPandas(detect, "key long, tie long, kind string, value string")


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows (key, clean, n_entities, kinds) for every row of ``docs`` (doc_id, text).

    Every occurrence of an entity gets the same surrogate in all documents, in the format of the occurrence;
    another entity of its type never gets it. ``key`` is the secret. Texts without entities, null and empty
    ones come back as they are. Rows that repeat a doc_id, or have none, are told apart by their texts.
    """
    with scratch() as kept:
        found = materialize(entity_rows(docs).distinct(), "found")
        mapping = assign_surrogates(found, key)
        own = found.join(mapping, ["kind", "value"]).groupBy("key", "tie").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("swap"))
        own = materialize(own, "swaps")
        kept.append(own)

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean, n, kinds = [], [], []
            for text, pairs in zip(pdf["text"], pdf["swap"]):
                if pairs is None:
                    clean.append(text), n.append(0), kinds.append("")
                    continue
                table = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}
                out, at, seen = [], 0, []
                for start, end, kind, value in find_entities(text):
                    out += [text[at:start], format_like(text[start:end], kind, table[kind, value])]
                    at = end
                    seen.append(kind.partition(":")[0])
                clean.append("".join(out) + (text or "")[at:] if seen else text), n.append(len(seen)), kinds.append(",".join(sorted(set(seen))))
            yield pd.DataFrame({"key": pdf["key"], "clean": pd.Series(clean, dtype=object), "n_entities": pd.Series(n, dtype="int64"), "kinds": pd.Series(kinds, dtype=object)})

    # the table of swaps grows with the corpus: it is dealt out like the texts at every size, never broadcast
    return _texts(docs).join(own.hint("merge"), ["key", "tie"], "left").mapInPandas(swap, "key long, clean string, n_entities long, kinds string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data; the key of this query is public and for tests."""
    found = replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), b"public test key")
    return found.select(key_to_id("key").alias("doc_id"), F.col("clean").alias("text"), "n_entities", "kinds")
