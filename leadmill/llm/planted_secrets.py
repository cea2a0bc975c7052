"""Labelled findings for the secret scan: made secrets, and things alike that are none, between pieces of given texts.

Everything follows from one seeded generator, so equal pieces give equal findings. Labels alternate: 1, 0, 1, 0. Each secret is of one of FORMS, and whole
forms can be left out, so that a test can ask for forms that the training never saw. A secret without a name beside it is one that random characters
give away; the forms of NAMED (what a person might choose, and what could be an ordinary value) stand under a secret's name or within an address.
"""

from __future__ import annotations

import base64
import re
import string
from random import Random
from typing import NamedTuple

#: Words for tables that have none.
FALLBACK = ["the word stands before another one and after it comes the next", "in this line there are some plain words for a small example"]

#: How public services' tokens begin, and their usual lengths after that.
PREFIXES = (("ghp_", 36), ("gho_", 36), ("glpat-", 20), ("sk_live_", 24), ("xoxb-", 40), ("AKIA", 16), ("ASIA", 16), ("AIza", 35), ("npm_", 36), ("SG.", 66), ("dop_v1_", 64), ("hf_", 34))
NAMES = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "client_secret", "token", "auth_token", "access_token", "api_key", "apikey", "key", "access_key", "private_key", "credential", "credentials",
    "authorization", "auth", "bearer", "session", "cookie", "signature", "login", "Kennwort", "clave", "contraseña", "clé", "mot de passe",
)
OTHER_NAMES = ("id", "name", "version", "host", "url", "path", "file", "date", "user", "email", "phone", "size", "count", "ref", "class", "see", "order", "number", "build", "page", "card", "ip", "Nummer", "fecha", "tel")
_JOIN = ("{n} = \"{s}\"", "{n}: {s}", "{n}={s}", "{n} '{s}'", "--{n} {s}", "{n} is {s}", "{n}=\"{s}\"", "\"{n}\": \"{s}\"", "{n} {s}")
#: Joins that assign: what looks like a word is a secret only there.
_GIVEN = ("{n} = \"{s}\"", "{n}: {s}", "{n}={s}", "{n} = {s}", "{n}: '{s}'", "\"{n}\": \"{s}\"")
_LETTERS = re.compile(r"[^\W\d_]{3,}")

_HEX, _BASE62, _URL64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"


#: Forms of secrets, those of under `long` characters first; NAMED ones never stand bare.
SHORT_FORMS = ("code", "password", "lower", "leet", "capital", "letters", "brief")
LONG_FORMS = ("hex", "upper hex", "digest", "base62", "base64", "url64", "prefixed", "signed", "base32", "phrase", "uuid")
NAMED = ("password", "lower", "leet", "capital", "letters", "brief", "phrase", "uuid")


class Finding(NamedTuple):
    text: str
    start: int
    end: int
    label: int
    form: str = ""


class _Maker:
    def __init__(self, pieces: list[str], seed: int):
        self.rng, self.pieces = Random(seed), pieces
        self.words = sorted({w for p in pieces for w in _LETTERS.findall(p)}) or ["word"]
        self.plain = [w for w in self.words if w.isascii()] or ["word"]

    def chars(self, of: str, least: int, most: int) -> str:
        return "".join(self.rng.choices(of, k=self.rng.randint(least, most)))

    def word(self) -> str:
        return self.rng.choice(self.plain)

    def digits(self, least: int, most: int) -> str:
        return self.chars(string.digits, least, most)

    # Secrets.

    def value(self, form: str) -> str:
        r = self.rng
        swap = str.maketrans("aeiost", "431057")
        if form == "code":
            while True:
                s = self.chars(r.choice((_BASE62, _HEX, _BASE62)), 12, 19)
                if re.search("[0-9]", s) and re.search("[A-Za-z]", s):
                    return s
        if form == "signed":
            return "eyJ" + ".".join(self.chars(_URL64, a, a + 30) for a in (17, 30, 30))
        if form == "prefixed":
            prefix, n = r.choice(PREFIXES)
            return prefix + self.chars(string.ascii_uppercase + string.digits if len(prefix) == 4 and prefix.isupper() else _BASE62, n, n)
        if form == "base64":
            return base64.b64encode(r.randbytes(r.randint(15, 48))).decode()
        if form == "uuid":
            return "-".join(self.chars(_HEX, n, n) for n in (8, 4, 4, 4, 12))
        if form == "phrase":
            s = r.choice("-._").join(self.word().lower() for _ in range(r.randint(3, 5)))
            return (s + r.choice(("-", "_", "")) + self.chars(string.ascii_lowercase + string.digits, 3, 7) if r.random() < 0.7 else s).ljust(20, "x")[:60]
        if form in ("leet", "capital"):
            s = (self.word().translate(swap) if form == "leet" else self.word().capitalize()) + r.choice(("!", "#", "_", "", "$", "-")) + self.digits(2, 5) + r.choice(("", "!", "x", "?"))
            return (s + self.chars(_BASE62, 8, 8))[: r.randint(8, 16)] if len(s) < 8 or len(s) > 19 else s
        if form == "digest":
            n = r.choice((32, 40, 40, 64))
            return self.chars(_HEX, n, n)
        of, least, most = {
            "password": (_BASE62 + "!#$%&*?", 8, 19), "lower": (string.ascii_lowercase + string.digits, 8, 19), "letters": (string.ascii_lowercase, 8, 19), "brief": (r.choice((_BASE62, string.ascii_lowercase + string.digits, _BASE62 + "!#$")), 6, 7),
            "hex": (_HEX, 20, 64), "upper hex": (_HEX.upper(), 20, 64), "base62": (_BASE62, 20, 64), "url64": (_URL64, 20, 64), "base32": (string.ascii_uppercase + "234567", 20, 40),
        }[form]
        return self.chars(of, least, most)

    def secret(self, short: bool, left_out: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> tuple[str, str, str, str]:
        """What stands before, the secret, what stands after, and its form."""
        r = self.rng
        forms = [f for f in (SHORT_FORMS if short else LONG_FORMS) if f not in left_out and (not only or f in only)] or list(only)
        bare_forms = [f for f in forms if f not in NAMED]
        bare = bool(bare_forms) and r.random() < 0.3
        form = r.choice(bare_forms if bare else forms)
        s = self.value(form)
        if bare:
            return "", s, "", form
        if r.random() < 0.1 and form not in ("brief", "uuid", "base64"):
            return f"{r.choice(('https', 'postgres', 'amqp', 'ftp'))}://{self.word()}:", s, f"@{self.word().lower()}.example.com/{self.word().lower()}", form
        name = r.choice(NAMES)
        name = r.choice((name, name.upper(), f"{self.word().lower()}_{name}", name.capitalize()))
        join = r.choice(_GIVEN if form in ("letters", "brief", "phrase") else (*_JOIN, "{n}: Bearer {s}", "{n}: Basic {s}"))
        before, _, after = join.partition("{s}")
        return before.format(n=name), s, after, form

    # Others.

    def personal(self) -> str:
        """Numbers and addresses of persons: cards, phones, accounts, mail."""
        r, w = self.rng, lambda: self.word().lower()
        d = self.digits
        ways = (
            lambda: r.choice("34567") + d(15, 15), lambda: d(16, 16), lambda: r.choice(" -").join(d(4, 4) for _ in range(4)), lambda: f"+{d(1, 3)}-{d(2, 3)}-{d(3, 4)}-{d(3, 4)}", lambda: f"({d(3, 3)})-{d(3, 3)}-{d(4, 4)}", lambda: f"{d(3, 3)}-{d(3, 3)}-{d(4, 4)}",
            lambda: f"+{d(10, 13)}", lambda: f"0{d(3, 4)}/{d(6, 8)}", lambda: d(9, 12), lambda: f"{d(3, 3)}-{d(4, 4)}", lambda: f"{d(3, 3)}.{d(3, 3)}.{d(4, 4)}", lambda: f"{w()}.{d(2, 2)}@mail{d(1, 1)}.example.com", lambda: f"{w()}@{w()}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}",
            lambda: f"{w()}.{w()}@{w()}.{r.choice(('com', 'co.uk'))}", lambda: f"{w()[0]}{w()}{d(1, 3)}@mail.{w()}.com", lambda: f"{w()}_{w()}{d(0, 4)}@{w()}-{w()}.net", lambda: f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{d(18, 22)}", lambda: f"{w()}+{w()}@{w()}.com", lambda: f"<{w()}.{d(2, 2)}@{w()}.example.com>".strip("<>"),
        )
        return r.choice(ways)()

    def prose(self) -> str:
        """A word as it stands in a text, with what may stand behind it."""
        while True:
            s = self.rng.choice(self.words)
            s = self.rng.choice((s, s, s.capitalize(), s.upper(), f"{s}-{self.word()}", f"{s}/{self.word()}")) + self.rng.choice(("", "", "!", "?", "!!", "&&&", "###"))
            if s.isascii() and len(s) >= 4:
                return s
            s = self.word() + self.word().lower()
            if len(s) >= 8:
                return s

    def harmless(self, short: bool) -> str:
        r, w = self.rng, lambda: self.word().lower()
        two = lambda: f"{r.randint(0, 59):02d}"
        if short:
            ways = (
                lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: self.digits(8, 19), lambda: self.digits(14, 17), lambda: r.choice("3456") + self.digits(15, 15), lambda: f"{r.randint(1970, 2039)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
                lambda: f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}-{r.choice(('rc1', 'beta2', 'alpha', 'SNAPSHOT'))}", lambda: w() + w().capitalize() + r.choice(("", self.digits(1, 2))),
                lambda: f"{w()}_{w()}{self.digits(1, 3)}", lambda: f"{w()}/{w()}{self.digits(1, 2)}.{r.choice(('py', 'java', 'txt', 'html'))}", lambda: f"{w()}@{w()}.com", lambda: f"{w()}{self.digits(2, 4)}@mail.com",
                lambda: "-".join((self.digits(3, 4), self.digits(3, 4), self.digits(4, 4))), lambda: f"+{self.digits(2, 2)}-{self.digits(3, 3)}-{self.digits(5, 7)}", lambda: f"{self.digits(1, 3)}.{self.digits(5, 9)}",
                lambda: f"{two()}:{two()}:{two()}.{self.digits(2, 3)}", lambda: f"{w()}:{w()}", lambda: f"{w()}={w()}", lambda: f"#{self.chars(_HEX, 6, 6)}{r.choice(('', ';'))}x", lambda: f"{w()}{self.digits(1, 4)}",
                lambda: f"{w()}.{w().capitalize()}", lambda: r.choice("x*#.-") * r.randint(8, 19), lambda: f"{w()}{r.choice(('%%%', '&&&', '$$$', '###', '***'))}{self.digits(0, 2)}", lambda: f"{w()}-{w()}-{self.digits(1, 4)}",
                lambda: f"{w()[:2]}.{two()}@m{self.digits(1, 1)}.example.com", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}:{r.choice((80, 443, 8080))}", lambda: f"{w().upper()}_{w().upper()}_{self.digits(1, 1)}",
            )
        else:
            ways = (
                lambda: f"{w()}.{two()}@mail{self.digits(1, 1)}.example.com", lambda: f"https://{w()}.example.com/{w()}/{w()}?id={self.digits(1, 6)}", lambda: f"src/main/{w()}/{w()}/{w().capitalize()}{self.digits(1, 2)}.java",
                lambda: "-".join(self.chars(_HEX, n, n) for n in (8, 4, 4, 4, 12)), lambda: f"{r.randint(1970, 2039)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{two()}:{two()}:{two()}.{self.digits(3, 6)}Z",
                lambda: "".join(w().capitalize() for _ in range(4)), lambda: "_".join(w() for _ in range(4)) + self.digits(0, 2), lambda: "-".join(w() for _ in range(5)), lambda: f"/usr/lib/{w()}/{w()}{self.digits(1, 2)}/{w()}.so.{self.digits(1, 1)}",
                lambda: "".join(self.word() for _ in range(5)), lambda: self.word() + "".join(w() for _ in range(4)), lambda: self.digits(20, 24), lambda: f"{self.digits(4, 4)}-{self.digits(4, 4)}-{self.digits(4, 4)}-{self.digits(4, 4)}-{self.digits(2, 4)}",
                lambda: f"www.{w()}-{w()}.co.uk/{w()}/{w()}.html", lambda: f"{w()}.{w()}.{w()}.{w().capitalize()}{w().capitalize()}", lambda: r.choice("x*=#-_.") * r.randint(20, 60), lambda: f"your_{w()}_{w()}_{w()}_here",
                lambda: f"{w()}={self.digits(1, 3)}&{w()}={w()}&{w()}={self.digits(1, 5)}", lambda: f"{w()}.{w()}{two()}@{w()}{w()}.org", lambda: ("".join(self.word() for _ in range(2)) + r.choice(("***", "$$$", "&&&", "%%%", "###", ",,"))) * 2,
            )
        s = r.choice(ways)()
        while len(s) < 8 or (len(s) >= 20) == short:
            s = s[:19] if short and len(s) >= 20 else s + r.choice(("_", ".", "-", "/")) + w()
        return s

    def other(self, short: bool) -> tuple[str, str, str, str]:
        r = self.rng
        way = r.random()
        s = self.personal() if way < 0.35 else self.prose() if way < 0.5 else self.harmless(short)
        s += r.choice(("!", "!!", "?", "&&&", "***", "###", "$$$", "%%%")) if r.random() < 0.15 else ""
        if r.random() < 0.5:
            return "", s, "", ""
        # A secret's name before an ordinary word, as in prose about secrets.
        name = r.choice(OTHER_NAMES if r.random() < 0.85 else NAMES)
        before, _, after = r.choice(_JOIN if name in OTHER_NAMES else ("{n} is {s}", "{n} {s}", "{n}, {s}", "{s} {n}")).partition("{s}")
        return before.format(n=name), s, after.format(n=name), ""

    def finding(self, label: int, short: bool, left_out: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> Finding:
        r = self.rng
        before, s, after, form = self.secret(short, left_out, only) if label else self.other(short)
        left, right = (x[(k := r.randint(0, max(0, len(x) - 64))) : k + 64] for x in (r.choice(self.pieces), r.choice(self.pieces)))
        head = left[: r.randint(0, len(left))].rstrip("=:@/") + r.choice((" ", "\n", " (", " ")) + before
        tail = after + r.choice((" ", "\n", ". ", ", ", ") ", " $$$ ", " ### ")) + right
        return Finding(head + s + tail, len(head), len(head) + len(s), label, form)


def findings(pieces: list[str], each: int, seed: int = 11, left_out: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[Finding]:
    """`each` findings of either label, half of the secrets of SHORT_FORMS and half of LONG_FORMS, without those left out, or of `only` these."""
    make = _Maker(pieces, seed)
    return [make.finding(label, bool(k % 2), left_out, only) for k in range(each) for label in (1, 0)]
