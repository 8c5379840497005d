"""Makes the model file of ``pii`` from generated text: ``python -m kinfold.llm.pii_train``.

The text is composed from public forms: national numbering plans and identity numbers, postal
address forms, comment, log, configuration and mail conventions, and sentences of random common
words.  Names are partly common ones, partly invented syllables.  No corpus is read and no wording
is taken from one.  Since the generator knows what it put where, every candidate has a label.
Training uses TRAIN_TEXTS texts and the thresholds and calibration HELD_OUT_TEXTS others: these
are the bounds of the sample.
"""

from __future__ import annotations

import json
import random

import numpy as np

from kinfold.llm.boosting import BoostedTrees
from kinfold.llm.pii import KINDS, MODEL_FILE, candidates, features

TRAIN_TEXTS = 5000
HELD_OUT_TEXTS = 1600

ONSETS = "b d f g h j k l m n p r s t v w z br dr fl gr kl pr sk st th tr sh".split()
VOWELS = "a e i o u y ai ea io ou ø é á ü".split()
CODAS = ["", "", "n", "r", "s", "t", "lm", "nd", "rk", "sk", "x", "k"]
COMMON_GIVEN = "Maria John Anna James Wei Priya Mohammed Elena Lars Ingrid Pierre Camille Hans Greta Sofia Diego Lucia Yuki Kenji Amara Kwame Olga Ivan Fatima Omar Grace Henry Alice Emma Noah Liam Olivia Lucas Chloe Marta Pablo Giulia Marco".split()
COMMON_FAMILY = "Smith Johnson Brown Garcia Martinez Mueller Schmidt Fischer Dubois Laurent Rossi Bianchi Kowalski Novak Ivanov Petrov Sato Tanaka Chen Wang Kim Park Singh Patel Okafor Mensah Silva Santos Jensen Nilsson Larsen Virtanen Horvat Popescu Doe Miller Taylor Wilson".split()
#: Names that are also other words.
DOUBTFUL_GIVEN = "Robin Sage Sky August Jade Rune Ash Page May Grace Faith Mark Bill Will Rose Hope Dawn Frank".split()
DOUBTFUL_FAMILY = "Banks Field Key Marker Stone Winters Page Street Young Long Price Cook Baker King Bishop Wood Hill Rivers Banks Rice".split()
WORDS = ("after again all always array before between block both branch buffer cache call cannot carry change check clear client close code column common copy count data default delay each empty end entry "
         "error every field file first fixed flag follow format found from given group guard hash here hold index inner input into job keep key large last later layer left level line list local lock long "
         "loop made many mark match merge more most must name never next node none note now number offset old once only open order other outer output over own page parent part pass path pool port prefix "
         "previous print queue raise range read record reset result return right root row same scan second send server set share short side single size slot small sort source stack start state step still "
         "stop store string such table task than that then there thread time token total tree type under unit until update upper use user value version wait walk when where while whole with without work write").split()
FOREIGN = ("aber alle auch beim danach datei dieser einmal erst fehler hier immer jede kein leer letzte liste mehr nach nicht noch nur oder puffer schon sonst spalte und vorher wenn wert wieder zeile zuerst "
           "ainsi apres avant avec bloc chaque cle dans debut deja dernier encore erreur fichier fin ici jamais ligne liste mais meme mot page plus pour premier sans si taille tous toujours valeur vide").split()
PRODUCTS = ("Visual Studio", "Open Office", "Hash Map", "Red Black Tree", "Linear Model", "Google Chrome", "Apache Spark", "Mozilla Firefox", "Hello World", "United Kingdom", "New York", "San Francisco", "Base Class",
            "Monday Morning", "Data Frame", "Public License", "Free Software", "Windows Server", "Internet Explorer", "Unit Test", "Main Menu", "User Guide", "Service Level", "North America", "Great Britain")
LICENCES = ("Apache License", "Mozilla Public License", "Boost Software License", "Eclipse Public License", "Creative Commons", "Academic Free License", "Artistic License", "European Union Public Licence", "Common Terms", "Community Grant")
PEM = ("RSA PRIVATE KEY", "EC PRIVATE KEY", "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST", "OPENSSH PRIVATE KEY", "PGP MESSAGE", "ENCRYPTED PRIVATE KEY", "TEST PRIVATE KEY", "DUMMY TEST KEY", "EXAMPLE TEST KEY")
GROUPS = ("contributors", "authors", "team", "project", "foundation", "developers", "community", "maintainers", "consortium", "Inc.", "Ltd.", "GmbH", "Corporation", "Group", "University", "Institute", "Software Foundation", "Labs")
STREETS = ("Road", "Street", "Ave", "Avenue", "Lane", "Close", "Row", "St.", "Drive", "Way", "Court", "Square", "Terrace", "Place", "Blvd")
STATES = "CA NY TX WA IL MA OR FL DC CO".split()


class Maker:
    """Random words, names and lines; ``text`` collects parts, ``truth`` their places."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        made = lambda n: [self.word(self.r.choice([1, 2, 2, 3]), False).capitalize() for _ in range(n)]
        self.given = made(150) + COMMON_GIVEN + DOUBTFUL_GIVEN
        self.family = made(240) + COMMON_FAMILY + DOUBTFUL_FAMILY
        self.known_given = frozenset(n.casefold() for n in self.given if self.r.random() < 0.6)
        self.known_family = frozenset(n.casefold() for n in self.family if self.r.random() < 0.6)

    def word(self, n: int | None = None, plain: bool = True) -> str:
        vowels = VOWELS[:10] if plain else VOWELS
        return "".join(self.r.choice(ONSETS) + self.r.choice(vowels) + self.r.choice(CODAS) for _ in range(n or self.r.randint(2, 3)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTWXYZQ") for _ in range(n))

    def say(self, least: int = 2, most: int = 7) -> str:
        """A few common words in a row, mostly of one language, sometimes with an invented one."""
        bag = FOREIGN if self.r.random() < 0.15 else WORDS
        out = [self.r.choice(bag) for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.3:
            out[self.r.randrange(len(out))] = self.word()
        if self.r.random() < 0.15 and len(out) > 3:
            out[len(out) // 2] += ","
        return " ".join(out)

    def name(self) -> str:
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        if r.random() < 0.08:
            f += "-" + r.choice(self.family)[:6].capitalize()
        if r.random() < 0.03:
            f = r.choice(["O'", "O’", "D'"]) + f
        kind = r.random()
        if kind < 0.10:
            out = f"{g[0]}. {f}"
        elif kind < 0.18:
            out = f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {f}"
        elif kind < 0.27:
            out = f"{g} {r.choice(['van der', 'de', 'af', 'von', 'van', 'de la', 'di', 'den'])} {f}"
        elif kind < 0.42:
            return f"{f}, {g}"
        else:
            out = f"{g} {f}"
        return out.upper() if r.random() < 0.08 and "." not in out else out

    def email(self) -> str:
        r = self.r
        local = r.choice([f"{self.word(2)}.{self.word(2)}", f"{self.word(2)}_{self.word(2)}", f"{self.word(2)}", f"{self.word(2)}+{r.choice(WORDS)}", f"{self.word(2)}.{self.word(2)}{r.randint(1, 99)}", f"{self.word(1)[0]}{self.word(2)}", f"{r.choice(COMMON_GIVEN).lower()}.{r.choice(COMMON_FAMILY).lower()}"])
        host = [self.word(2) + r.choice(["", "", f"-{r.choice(WORDS)}"]), *r.choice([[], ["mail"], ["corp"]]), *r.choice([["example"], ["example", "com"], ["example", "org"], ["test"], ["invalid"], ["com"], ["org"], ["co", "uk"], ["de"], ["fr"]])]
        at, dot = r.choices([("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" AT ", " DOT "), (" at ", " dot "), ("%40", "."), ("&#64;", "."), ("\\u0040", ".")], [75, 6, 5, 5, 2, 4, 2, 2])[0]
        out = local + at + dot.join(host)
        return out.upper() if r.random() < 0.05 and at == "@" else out

    def phone(self) -> str:
        """Numbers in the national and international forms of several numbering plans, also those reserved for fiction."""
        d, r = self.digits, self.r
        area = f"{r.randint(2, 9)}{d(2)}"
        exchange = r.choice(["555", f"{r.randint(2, 9)}{d(2)}"])
        out = r.choice([
            f"+49 {r.choice(['30', '40', '89', '69'])} {d(5)}{d(3)}", f"+49 {d(3)} {d(7)}", f"0{r.choice(['30', '40', '89'])}/{d(5)}-{d(r.randint(2, 3))}", f"0{d(3)}/{d(6)}",
            f"+44 7{d(3)} {d(6)}", f"+44 (0){r.randint(1, 2)}{d(1)} {d(4)} {d(4)}", f"0{r.randint(1, 2)}{d(1)} {d(4)} {d(4)}", f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}",
            f"+61 4{d(2)} {d(3)} {d(3)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+46{d(2)}{d(7)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+91 {d(5)} {d(5)}",
            f"({area}) {exchange}-{d(4)}", f"1-{area}-{exchange}-{d(4)}", f"+1.{area}.{exchange}.{d(4)}", f"+1 ({area}) {exchange}-{d(4)}", f"{area}-{exchange}-{d(4)}", f"{exchange}-{d(4)}", f"{exchange}.{d(4)}", f"{area}{exchange}{d(4)}", f"+1{area}{exchange}{d(4)}"])
        if r.random() < 0.08 or out.startswith(exchange + "."):
            out += r.choice([f" x{r.randint(1, 999)}", f" ext. {r.randint(10, 9999)}", f"x{r.randint(10, 999)}"])
        return out

    def identity(self) -> tuple[str, str]:
        """A label and a number in the form of some state's or employer's numbering."""
        d, r, a = self.digits, self.r, self.letters
        birth = f"{d(2)}{r.randint(0, 12):02d}{r.randint(1, 31):02d}"
        return r.choice([
            (r.choice(["SSN", "ssn", "social security no."]), r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"])),
            (r.choice(["NINO", "NI number", "national insurance"]), r.choice([f"{a(2)}{d(6)}{r.choice('ABCD')}", f"{a(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"])),
            (r.choice(["tax id", "ITIN", "TIN"]), f"9{d(2)}-{d(2)}-{d(4)}"), (r.choice(["Steuer-ID", "steuerid", "IdNr."]), r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11)])),
            (r.choice(["passport", "passport no.", "Reisepass"]), r.choice([f"{a(1)}{d(8)}", d(9), f"{a(2)}{d(7)}", f"{a(1)}{d(7)}"])),
            (r.choice(["driving licence", "driver's license", "licence no."]), r.choice([f"{a(5)}{d(6)}{a(2)}{d(1)}{a(2)}", f"{a(4)}9{d(6)}{a(2)}{d(1)}{a(2)}", f"{a(1)}{d(7)}"])),
            (r.choice(["personnummer", "CPR", "henkilotunnus"]), f"{birth}{r.choice('-+-')}{d(4)}"), (r.choice(["national id", "ID card", "identity card"]), r.choice([f"{a(2)}{d(4)}-{d(5)}-{a(1)}", f"{d(8)}{a(1)}", f"{a(2)}{d(6)}", d(11)])),
            (r.choice(["staff id", "employee number", "personnel no.", "staff no"]), r.choice([f"EMP-{d(6)}", f"E-{d(6)}", f"{a(2)}-{d(5)}", f"STAFF-{d(5)}", f"HR-{d(6)}"])),
            ("CPF", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), ("Aadhaar", f"{d(4)} {d(4)} {d(4)}"), ("codice fiscale", f"{a(6)}{d(2)}{a(1)}{d(2)}{a(1)}{d(3)}{a(1)}"), (r.choice(["PESEL", "BSN", "fodselsnummer"]), r.choice([d(11), d(9)]))])

    def address(self, leader: str = "") -> str:
        r, w, d = self.r, lambda: self.word(2).capitalize(), self.digits
        town, n = r.choice([w(), w(), f"{w()} {w()}", r.choice(["Boston", "Leeds", "Hamburg", "Lyon", "Uppsala"])]), r.randint(1, 1999) if r.random() < 0.2 else r.randint(1, 240)
        kind = r.random()
        if kind < 0.42:
            street = f"{n}{r.choice(['', '', '', 'b'])} {w()}{r.choice(['', '', ' ' + w()])} {r.choice(STREETS)}"
            if r.random() < 0.1:
                street += " " + r.choice(["NW", "SE", "N", "SW"])
            if r.random() < 0.12:
                street += f", {r.choice(['Apt', 'Unit', 'Flat', 'Suite'])} {r.randint(1, 400)}"
            k = r.random()
            code = r.choice([f"{self.letters(2)}{r.randint(1, 9)} {d(1)}{self.letters(2)}", f"{self.letters(1)}{r.randint(1, 19)} {d(1)}{self.letters(2)}", d(5)])
            if k < 0.25:
                return street
            if k < 0.5:
                return f"{street}, {town} {code}"
            if k < 0.65:
                return f"{street}, {town}"
            if k < 0.78:
                return f"{street}, {town}, {r.choice(STATES)} {d(5)}"
            return f"{street}{r.choice([chr(10), chr(13) + chr(10)])}{leader}{town} {code}"
        if kind < 0.6:
            return f"{w()}{r.choice(['str.', 'straße', 'gasse', 'weg', 'platz', 'allee'])} {n}{r.choice(['', 'a', 'b'])}, {d(5)} {town}"
        if kind < 0.72:
            return f"{w()}{r.choice(['vägen', 'gatan', 'laan', 'straat'])} {n}, {r.choice(['', d(5) + ' '])}{town}"
        if kind < 0.86:
            return f"{n} {r.choice(['rue', 'rue de', 'rue du', 'avenue', 'boulevard', 'place'])} {w()}{r.choice(['', '', ' ' + w()])}, {d(5)} {town}"
        return f"{r.choice(['PO Box', 'P.O. Box', 'Postfach'])} {r.randint(100, 9999)}, {r.choice(['', d(5) + ' '])}{town}"

    def line(self) -> list[tuple[str, int | None]]:
        """Parts (text, kind or None) of one line, without its end."""
        r = self.r
        lead = r.choice(["// ", "# ", "* ", "- ", "", "-- ", "/* ", "## ", "; "])
        if r.random() < 0.45:
            return self.plain_line(lead)
        N, E, P, A = (self.name(), 4), (self.email(), 0), (self.phone(), 1), (self.address(lead), 3)
        label, number = self.identity()
        I = (number, 2)  # noqa: E741
        v, w, some, more = self.word(), self.word(), self.say(1, 4), self.say(1, 5)
        bare = lambda *parts: [q for p in parts for q in (bare(*p) if isinstance(p, list) else [(p, None) if isinstance(p, str) else p])]
        say = lambda *parts: bare(lead, *parts)
        after = r.choice(["", "", f" {some}", f", {some}", f" ({some})", f": {some}"])
        flat = (self.flat_address(), 3)
        title = r.choice(["Mr ", "Mrs. ", "Dr. ", "Prof. ", "Frau ", "Herr ", "Mme "])
        choices = [
            lambda: say(r.choice(["Author: ", "Signed-off-by: ", "Written by: ", "Maintainer: ", "@author ", "@author: ", "Autor: ", "Co-authored-by: ", "Acked-by: ", "Original version by: ", "Contact: "]), N, r.choice([[" <", E, ">"], [" (", E, ")"], [], [", ", P, ""]])),
            lambda: say(r.choice(["Copyright (c) ", "Copyright ", "(C) ", "© "]), f"{r.randint(1994, 2024)}{r.choice(['', '', f'-{r.randint(2015, 2024)}', ','])} ", N, r.choice(["", "", ". All rights reserved.", f" {some}"])),
            lambda: say(r.choice(["Reported by ", "Suggested by ", "Thanks to ", "Patch from ", "Fix by ", "gemeldet von ", "signale par ", "Reviewed by ", "Tested by ", "ask ", "see mail from ", "Reviewed with ", "approved by "]), N, after),
            lambda: say(f"{r.choice(['TODO', 'FIXME', 'XXX', 'HACK'])}(", N, f"): {more}"), lambda: say(f"{some} ", r.choice(["by ", "for ", "from ", "to ", "with ", "via "]), N, after),
            lambda: say(r.choice(["my name is ", "I am ", "this is ", "meeting with ", "The meeting with ", "spoke to ", "Please reach ", "according to ", "interview with ", "lunch with ", "questions to ", "call with "]), r.choice(["", "", title]), N, r.choice([".", f" {some}", ", ", f" {more}."])),
            lambda: bare(r.choice(["", title]), N, r.choice([" wrote: ", " said ", " asked for ", " will ", " joined ", " left the ", " has ", " is ", " was ", " works on "]), more), lambda: say(f"{some} ", r.choice(["mail ", "contact ", "ping ", "write to ", "bitte an ", "questions: "]), E, after), lambda: say(E, after),
            lambda: say(N, r.choice([", ", "; ", " / ", " - "]), P, r.choice([", ", "; "]), E), lambda: say(N, ", ", A), lambda: say(r.choice(["client ", "patient ", "user ", "customer ", "applicant "]), N, f" ({label}: ", I, f"){after}"),
            lambda: say(N, r.choice([" lives at ", " moved to ", " of ", ", resident at "]), A, r.choice([f" {some}", f", {some}"])),
            lambda: say(r.choice(["office: ", "Address: ", "address is ", "Anschrift: ", "Adresse : ", "post to ", "ship to ", "deliver to ", "sent to ", "we are at ", "found at "]), A, r.choice(["", "", f" {some}"])), lambda: say(A),
            lambda: say(r.choice(["tel ", "Tel. ", "Tel: ", "phone ", "call ", "mobile ", "desk phone ", "Fax ", "ring ", "on call "]), P, after), lambda: say(f"{some} ", P, after),
            lambda: say(f"{some}{r.choice([' ', ': ', ' for '])}{label}{r.choice([' ', ': ', ' is ', ' = ', ' no '])}", I, after), lambda: say(f"{label}{r.choice([' ', ': ', '=', ' # '])}", I),
            lambda: bare(f"  {r.choice(['owner', 'author', 'assignee', 'approver', 'name', 'lead'])}: ", r.choice(["", '"']), N), lambda: bare(f"  {r.choice(['phone', 'pager', 'mobile', 'fax'])}: ", r.choice(["", "'", '"']), P), lambda: bare(f'  {r.choice(["email", "notify", "mailto", "cc"])}: "', E, '"'),
            lambda: bare(f'  "{r.choice(["author", "maintainer", "creator"])}": "', N, " <", E, '>",'), lambda: bare(f'  "{r.choice(["fullName", "name", "holder"])}": "', N, f'", "{label}": "', I, '",'), lambda: bare(f'  "{r.choice(["phone", "tel", "contact"])}": "', P, '",'), lambda: bare(f'  "{r.choice(["address", "street", "shipTo"])}": "', flat, '",'),
            lambda: bare(f'\t{v}.{r.choice(WORDS)}("', E, f'", {r.randint(1, 99)});'), lambda: bare(f'<a href="mailto:', E, f'">{some}</a>'), lambda: bare(f'\t{r.choice(WORDS)}({v}.{r.choice(["owner", "user", "author", "name"])}, "', N, '");'),
            lambda: bare(f'\t{r.choice(WORDS)}("', N, '", "', P, '");'), lambda: bare(f'\t{r.choice(["log", "print", "warn", "debug"])}("{more} ', N, ", ", some, " ", E, '");'), lambda: bare(f'\t{r.choice(["log", "print", "warn"])}("{more} ', r.choice([N, P, E, I]), '");'),
            lambda: bare(f"INSERT INTO {v} VALUES ({r.randint(1, 9999)}, '", N, "', '", E, "', '", P, "');"), lambda: bare(f"INSERT INTO {v} ({w}) VALUES ('", r.choice([N, I, flat]), "');"), lambda: bare(f'\t{v} = "', N, ";", flat, ";", P, '";'), lambda: bare(N, ",", E, ",", P, f",{r.randint(1, 99)}"),
            lambda: bare(f'    {v}.{label.split()[0].lower()} = "', I, '"'), lambda: bare(f'{r.choice(["const", "let", "var", "final String"])} {v} = "', r.choice([N, E, P, I, flat]), '";'), lambda: bare(f'    assert {v} == "', r.choice([N, E, P, I]), '"'),
            lambda: bare(f"function {w[:2]}(e){{return c.{v}({r.randint(1, 99)})}}{r.choice(['', ';'])}/*! ", N, " ", E, f" */function {w[:2]}(i){{return b.{v}(7)}}"), lambda: bare("/*! ", N, r.choice([" ", " <", ", "]), E, r.choice([" */", "> */"])),
        ]
        return r.choice(choices)()

    def flat_address(self) -> str:
        while "\n" in (a := self.address()):
            pass
        return a

    def plain_line(self, lead: str) -> list[tuple[str, int | None]]:
        """A line without personal information, mostly with something that looks like it."""
        r, v, w, d, a = self.r, self.word(), self.word(), self.digits, self.letters
        V, W = self.word(2).capitalize(), self.word(2).capitalize()
        f = r.choice([r.choice(self.family), V])
        g = r.choice([r.choice(self.given), W])
        tail = r.choice(["", "", ".", f" ({self.say(2, 5)})", f" {self.say(1, 4)}"])
        octet = lambda: str(r.randint(0, 255))
        noun = lambda: r.choice(WORDS)
        return [(r.choice([
            lambda: f"{lead}{r.choice(['Copyright (c)', 'Copyright', '(C)'])} {r.randint(1994, 2024)} {r.choice(['the ', 'The ', ''])}{r.choice([V, f'{V} {W}', f'{g} {f}'])} {r.choice(GROUPS)}", lambda: f"{lead}{self.say(3, 9)}{tail}", lambda: f"{lead}{self.say(3, 9).capitalize()}{tail}", lambda: f"{lead}{self.say(2, 5)}. {V} {self.say(2, 5)}{tail}",
            lambda: f"{lead}{r.choice(['build', 'release', 'rev', 'serial', 'batch'])} {d(4)}-{d(2)}-{d(4)}{tail}", lambda: f"{lead}{r.choice(['crc', 'checksum', 'size', 'offset', 'epoch', 'uid', 'order', 'invoice'])} {d(r.randint(8, 12))}{tail}", lambda: f"{lead}{r.choice(['ratio', 'fraction', 'mean', 'value'])} {d(3)}.{d(3)}.{d(4)}{tail}",
            lambda: f"{lead}{r.choice(['range', 'rows', 'pages', 'lines', 'ports'])} {d(3)}-{d(r.randint(3, 4))}{tail}", lambda: f"{lead}{r.choice(['ticket', 'issue', 'bug', 'task', 'see', 'CVE', 'RFC', 'ISO'])} {a(r.randint(2, 4))}-{d(r.randint(3, 5))}{tail}", lambda: f"{lead}{r.choice(['IBAN', 'account'])} {a(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}{tail}", lambda: f"{lead}{r.choice(['card', 'pan'])} {d(4)} {d(4)} {d(4)} {d(4)}{tail}",
            lambda: f"{lead}{r.choice(['ISBN', 'isbn'])} 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}{tail}", lambda: f"{lead}{noun()} {V} {f} {self.say(1, 4)}{tail}", lambda: f"{lead}{noun()} {V} {W} {r.choice(['holds', 'has', 'takes', 'stores', 'uses'])} {d(2)} {r.choice(STREETS)} {noun()}{tail}",
            lambda: f"{lead}{r.choice(['needs', 'uses', 'requires', 'npm install'])} {v}@{d(1)}.{d(2)}.{d(1)}{tail}", lambda: f"{lead}import {r.choice(['from ', ''])}@{v}/{w}{tail}", lambda: f"{lead}git clone git@{v}.{r.choice(['example', 'com', 'org'])}:{w}/{noun()}.git{tail}", lambda: f"{lead}ssh {v}@{w}.example:/{noun()}{tail}",
            lambda: f"{lead}{r.choice(['https', 'ftp', 'postgres'])}://{v}:{w}@{noun()}.{v}.{r.choice(['test', 'example', 'com'])}/{d(2)}{tail}", lambda: f"{lead}{r.choice(['listening on', 'bound to', 'peer', 'from'])} {octet()}.{octet()}.{octet()}.{octet()}:{d(4)}{tail}", lambda: f"{lead}{r.choice(['at', 'on', 'since'])} {d(4)}-0{d(1)}-1{d(1)} 1{d(1)}:{d(2)}:{d(2)}{tail}",
            lambda: f"{lead}{r.choice(['uuid', 'id', 'guid'])} {d(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}{tail}", lambda: f"{lead}{r.choice(['uuid', 'id', 'trace'])} {d(4)}{a(3).lower()}{d(1)}-{a(1).lower()}{d(2)}{a(1).lower()}-{d(4)}{tail}", lambda: f"{lead}{r.choice(['id', 'key'])} {d(8)}-{d(4)}-{d(4)}{tail}", lambda: f"{lead}{r.choice(['address', 'pointer', 'mask'])} 0x{d(8)} {self.say(1, 3)}{tail}",
            lambda: f"{lead}{v}.{r.choice(STREETS[:4])} {noun()} {w}.{r.choice(STREETS[:4])}{tail}", lambda: f"{lead}{r.choice(['root', 'admin', v])}@{r.choice(['localhost', v])} {self.say(1, 4)}{tail}", lambda: f"{lead}{r.choice(['ssn', 'phone', 'email', 'name'])}_{noun()} {self.say(2, 6)}{tail}", lambda: f"{lead}Code generated by {v}. DO NOT EDIT.",
            lambda: f"{lead}{r.choice(LICENCES)} {r.choice(['v', '', 'Version '])}{d(1)}.{d(1)}", lambda: f"{r.choice([V, W])} {r.choice(['License', 'Licence', 'Terms', 'Grant', 'Notice', 'Agreement'])} {d(1)}.{d(1)}", lambda: f"{lead}{r.choice(['the ', 'a ', 'our ', 'see ', ''])}{r.choice(PRODUCTS)} {self.say(1, 5)}{tail}", lambda: f"{lead}{r.choice(PRODUCTS)} {r.choice([d(4), d(1) + '.' + d(1)])}{tail}",
            lambda: f"{r.choice(['INSERT INTO', 'insert into'])} {v} VALUES ({d(3)}, {d(5)});", lambda: f"ALTER TABLE {v} ADD COLUMN {w} {r.choice(['INTEGER', 'TEXT', 'BIGINT'])};", lambda: f"SELECT {v}_id, {w} FROM {v} WHERE {w} > {d(3)};", lambda: f"UPDATE {v} SET n = {d(5)} WHERE i = {d(3)};", lambda: f"CREATE TABLE {v} ({w} INTEGER NOT NULL PRIMARY KEY);", lambda: f"-----{r.choice(['BEGIN', 'END'])} {r.choice(PEM)}-----",
            lambda: f"\t{v} = {noun()}_{w}[\"{v}\"];", lambda: f"\tif ({v}.{w} > {d(3)}) {{ return {w}; }}", lambda: f"  public {V} {noun()}{V}(final int {v}) {{", lambda: f"export {v.upper()}_{noun().upper()}={d(3)}", lambda: f"  static final int F_{v}_{d(2)} = {d(5)};", lambda: f"const {v}{d(2)} = 0x{d(4)};", lambda: f"{v}_{d(2)} = {d(r.randint(5, 10))}",
            lambda: f"  \"{v}_{noun()}\": {d(r.randint(4, 10))},", lambda: f"\t{{\"{v}\", {d(5)}, {d(2)}}},", lambda: f"_{a(1)}[{d(2)}] = ('{v}', {d(5)})", lambda: f"{d(8)}{v[:2]}{d(12)}", lambda: f"func {noun().capitalize()}{V}({noun()} *{V}) error {{", lambda: f"{v.upper()}_{r.choice(['SECRET', 'TOKEN', 'KEY'])}: {noun()}-{noun()}-{d(20)}", lambda: f"auth: {r.choice(['Bearer', 'Basic'])} {a(2).lower()}.{d(12)}.{d(14)}",
            lambda: f"{lead}{r.choice(['the', 'this', 'each', 'der', 'la'])} {V} {f} {noun()} {self.say(1, 4)}{tail}", lambda: f"function {V}{W}(e){{return {v}({d(2)})}}", lambda: f"class {V}{W}({noun().capitalize()}):", lambda: f"{lead}{r.choice(['see', 'cf.', 'use', 'call', 'try', 'like'])} {V} {f} {r.choice(['in', 'on', 'of'])} the {noun()}{tail}", lambda: f"{lead}{self.say(1, 3)} {r.choice(['Names', 'Terms', 'Parts', 'Copies'])} of the {noun()} {self.say(2, 5)}.",
            lambda: f"\t{v} = \"{v}@{d(1)}.{d(1)}.{d(2)}\";", lambda: f"{lead}{V} {W} {r.choice(['Module', 'Table', 'Engine', 'Server', 'Library', 'Parser', 'Service'])}{tail}", lambda: f"{lead}{d(2)} {V} {noun()} {self.say(1, 3)}{tail}", lambda: f"{lead}{v} {d(2)}.{d(2)}.{d(4)} {noun()}{tail}", lambda: f"{lead}{r.choice(['v', 'version '])}{d(1)}.{d(2)}.{d(3)}-{d(4)}{tail}",
        ])(), None)]

    def text(self) -> tuple[str, set[tuple[int, int, int]]]:
        out, truth = "", set()
        end = self.r.choice(["\n", "\n", "\n", "\r\n"])
        for _ in range(self.r.randint(6, 18)):
            for part, kind in self.line():
                if kind is not None and part:
                    truth.add((len(out), len(out) + len(part), kind))
                out += part
            if out[-1:].isalnum() and self.r.random() < 0.15:
                out += f" ({self.say(2, 6)})"
            out += self.r.choice(["", "", "", ".", " */"]) + end
        return out, truth


def sample(seed: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind the features and labels of all candidates of ``n`` generated texts."""
    maker = Maker(seed)
    rows: list[list] = [[] for _ in KINDS]
    labels: list[list] = [[] for _ in KINDS]
    missed = [0] * len(KINDS)
    for _ in range(n):
        text, truth = maker.text()
        seen = set()
        for c in candidates(text):
            hit = (c.start, c.end, c.kind) in truth
            seen.add((c.start, c.end, c.kind))
            rows[c.kind].append(features(text, c, maker.known_given, maker.known_family))
            labels[c.kind].append(hit)
        for t in truth - seen:
            missed[t[2]] += 1
            if missed[t[2]] <= 3:
                print("no candidate for", KINDS[t[2]], repr(text[t[0]:t[1]]))
    print("true spans without a candidate:", dict(zip(KINDS, missed)), "of", {k: int(sum(x)) for k, x in zip(KINDS, labels)})
    return [(np.array(x), np.array(y, float)) for x, y in zip(rows, labels)]


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * margin).sum() - 1e-2 * a, (y - p).sum()])
        m = np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = max(0.05, a + 0.5 * step[0]), b + 0.5 * step[1]
    return float(a), float(b)


def main(seed: int = 5) -> None:
    train = [sample(seed + s, TRAIN_TEXTS // 4) for s in range(4)]
    held = [sample(seed + 100 + s, HELD_OUT_TEXTS // 4) for s in range(4)]
    out = {}
    for k, kind in enumerate(KINDS):
        x, y = (np.concatenate([part[k][i] for part in train]) for i in (0, 1))
        hx, hy = (np.concatenate([part[k][i] for part in held]) for i in (0, 1))
        trees = BoostedTrees.fit(x, y)
        slope = calibrate(trees.margins(hx), hy)
        p = 1 / (1 + np.exp(-(slope[0] * trees.margins(hx) + slope[1])))
        grid = np.linspace(0.1, 0.9, 33)
        f1 = [2 * ((p >= t) & (hy == 1)).sum() / max(1, (p >= t).sum() + hy.sum()) for t in grid]
        good = grid[np.array(f1) >= max(f1) - 1e-4]
        threshold = float(good[np.abs(good - 0.5).argmin()])
        print(kind, "candidates", len(x), "positive", int(y.sum()), "held-out F1", round(max(f1), 4), "threshold", round(threshold, 3))
        out[kind] = {"trees": trees.to_json(), "slope": [round(s, 5) for s in slope], "threshold": round(threshold, 3)}
    MODEL_FILE.write_text(json.dumps(out, separators=(",", ":")))


if __name__ == "__main__":
    main()
