"""Labelled spans for the tagger of personal information, and its training.

Texts are written by a generator: survey notes with invented persons, numbers and places, then scanner noise, broken lines and
mixed case; the generator knows every span. ``python -m cadastrix.llm.pii_training OUT SECONDS WORKERS`` trains and writes the
model file. Workers train on their own texts and average their weights every few steps.
"""

from __future__ import annotations

import random
import sys
import time
from multiprocessing import Pipe, Process

import numpy as np

from .pii import CLASSES, KINDS, LETTERS, TAGS, char_class, letter_id

# Material of the generator; common given names and surnames of several languages, and pieces of invented ones.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Ashley Steven Emily
    Andrew Donna Joshua Carol Kevin Amanda Brian Melissa George Deborah Edward Laura Ronald Cynthia Jason Rebecca Jeffrey Sharon Ryan Kathleen Gary Amy Nicholas Angela Eric Shirley Jonathan Anna Stephen Ruth Larry Brenda Justin
    Pamela Scott Nicole Brandon Katherine Benjamin Samantha Samuel Christine Gregory Rachel Frank Janet Raymond Catherine Patrick Maria Jack Heather Dennis Diane Jerry Olivia Tyler Julie Aaron Joyce Henry Victoria Adam Kelly Douglas
    Carlos Luis Miguel Rosa Carmen Sofía Andrés Lucía Pedro Elena Hans Ursula Jürgen Ingeborg Klaus Sabine Friedrich Pierre François Hélène Chloé Antoine Benoît Giulia Marco Paolo Francesca Ahmed Fatima Omar Layla Hassan Aisha
    Wei Ming Hui Yan Kenji Sakura Haruto Min-jun Rajesh Anjali Vikram Sunita Olga Dmitry Natasha Sergei Katarzyna Piotr Lars Astrid Sven Nils Ebba Kofi Ama Chidi Ngozi Ravi Leah Ezra Ida Otis Cora Hugo Vera Max Ada Ivan Zoë""".split()
SURNAMES = """Smith Johnson Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams
    Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Woods Lane Street Court Marsh Brooks Fields Banks Rivers Manor Parks Bridges Waters Forest Church Wall Stone Poole Schmidt Weber Fischer Becker Dubois Lefèvre Moreau Rossi Conti
    Kowalski Novak Ivanova Petrov Tanaka Suzuki Kim Park Chen Wang Singh Patel Sharma Okafor Mensah Haddad Nasser Olsen Lindqvist Nyström O'Brien McDonald MacLeod DeWitt""".split()
ONSET = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p ph pl pr qu r rh s sc sh sk sl sm sn sp st str sw t th tr tw v w wh wr x y z".split()
VOWEL = "a e i o u ai au ea ee ei ie oa oo ou ow ay ey".split()
CODA = "b ck d ff g l ll lm ln m mp n nd ng nk nn nt p r rd rk rl rm rn rs rt s sk ss st t th tt v x z".split()
SUR_END = "son sen ton man mann berg stein witz ski sky ova ovich ez ini elli etti eau ard ault ström qvist dottir wala oğlu ley well ford field ham wood worth ing er ers kin ka ko lund gaard dahl vik bach heim hoff".split()
ROAD_END = "wood field ford ham ton ley dale brook bury land ridge view hurst stead croft shire gate bridge mere port haven cliff combe worth wick by thorpe den hill shaw lea fold moor".split()
DIRECTION = ["North", "Old", "Upper", "Little", "Saint", "Mount", "West", "N", "N.", "W", "W.", "Upr", "St", "St.", "Mt", "Mt.", "Ltl", "Lit.", "East", "South", "E", "S.", "Lower", "New", "Great"]
ROAD_TYPE = "Court Ct Ct. Place Pl Pl. Road Rd Rd. Lane Ln Ln. Trail Tr Tr. Trl Drive Dr Dr. Drv Street St St. Str Avenue Ave Ave. Av Terrace Ter Ter. Terr Terr. Circle Cir Cir. Circ Boulevard Blvd Blvd. Way Wy".split()
FULL_TYPE = ["Court", "Place", "Road", "Lane", "Trail", "Drive", "Street", "Avenue", "Terrace", "Circle", "Boulevard", "Way"]
FIRM_END = ["Surveys", "Surveying", "Survey Co.", "Land Surveying", "Engineering, P.A.", "Engineering LLC", "Engineers", "Associates", "Associates, Inc.", "Partners, Inc.", "Group", "Geomatics LLC", "Consultants", "and Sons", "& Co.", "Brothers", "Mapping", "Builders Inc.", "Title Company", "Bank", "and Level", "Chain Co."]
HOST_END = ["com", "org", "net", "example", "test", "invalid", "example.com", "example.org", "example.net", "co.uk", "gov", "edu", "info"]
DOMAIN = "surveys maps office post mail tide copper oak land title home county plumb harbor river stake field north data north-star web desk clerk print studio works".split()
NOUN = """wall fence corner pipe stone hedge drain garage culvert pole ditch porch shed marker bearing curb line iron pin rebar cap tree stump bench creek pond path gate deck slope roof chimney grade basin marsh field swale meter valve hydrant contour sheet plan page file box drawer letter invoice copy print record folder office counter board hearing request reply
    flower shrub lawn garden barn horse dog cat door window kitchen cellar attic garage tractor truck trailer boat dock beach shore island bank river hill valley ridge rock boulder sand clay soil water rain snow wind frost light power wire cable tank pump
    hydrant sewer septic permit deed plat title mortgage loan tax fee price cost bill receipt meeting agenda minutes notice order rule law code zone zoning variance buffer setback easement access lane line area volume weight height depth length width distance
    angle degree azimuth datum station level tripod prism tape chain rod staff camera photo map chart scale legend symbol border margin title block stamp seal ink paper pencil marker paint ribbon flag lath hub nail spike monument disk witness tie
    school church store market bridge tunnel station airport harbor farm ranch forest meadow orchard vineyard cemetery tower mill mine quarry well spring fountain statue bench table chair lamp clock bell key lock chainsaw shovel hammer bucket rope
    morning afternoon evening night week month year spring summer autumn winter holiday monday tuesday wednesday thursday friday""""".split()
VERB = """found set moved checked marked shown missing buried broken cleared measured staked recorded replaced removed painted flagged leaning disturbed settled dug tied closed opened printed returned signed delayed
    approved denied pending required requested noted observed verified confirmed corrected revised updated attached enclosed included excluded covered exposed blocked flooded frozen cut filled graded paved planted trimmed fenced locked rented sold owned
    built rebuilt repaired lifted lowered aligned offset rotated scanned copied filed lost found""""".split()
ADJ = """old new north south east west rear front side wooden concrete bent rusty low high wet dry narrow wide shared common upper lower second third first left right missing
    overhead underground temporary permanent public private legal final rough smooth steep flat deep shallow heavy light dark bright clean dirty empty full broken loose tight solid hollow iron brick stone wire plastic copper brass steel clear cloudy cold hot
    real total average maximum minimum standard special general local rural urban annual monthly daily""""".split()
PLACE = "beside behind near along under above past opposite across from inside outside at by".split()
# Cues of items and lines around them; <n> name, <p> phone, <m> mail, <i> identity number, <a> street address; # a digit, {r} a road, {t} a town, {f} a firm, {s} other words.
CUE = {
    "n": ["Owner", "OWNER:", "Owner name:", "Tenant", "TENANT", "Applicant:", "Prepared for", "Prepared by", "Drawn by", "Checked by", "Attn:", "ATTN", "c/o", "cc:", "Seller", "Buyer", "Grantor", "Grantee", "Witness", "Heir of", "Party chief", "Signed,", "Signature", "Contact:", "Contact person", "Client", "Surveyor", "Crew chief", "Notes by", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Drs.", "Hon.", "Spoke to", "Spoke with", "Ask for", "Call", "Met", "Dear", "per", "from", "To:", "From:", "Attention", "Executor", "Trustee", "Agent for owner:", "next of kin", "Sincerely,", "Driller", "Rod:", "Notary", "Clerk"],
    "p": ["Tel", "TEL", "Tel.", "TEL:", "Phone", "Phone:", "Ph.", "ph", "Fax", "FAX", "Cell", "cell", "Mobile:", "call", "Call", "ring", "text", "dial", "Office", "Home", "reach at", "Voicemail", "Hotline", "T:", "F:", ""],
    "m": ["E-mail", "Email:", "email", "Mail", "write to", "send to", "mail", "cc", "e-mail:", "reply to", "contact", "Questions:", ""],
    "a": ["Address", "ADDRESS:", "Address -", "Site address", "SITE ADDRESS", "Property address:", "Premises", "Premises address:", "Location:", "Mailing address", "lives at", "resides at", "at", "house at", "Deliver to", "Send to", "Office:", "re", "Re:", "of", "neighbor at", "tenant at", "Job at", "Meet at", "mail to", ""],
}
WITH = """<n>|<a>|<n> {s}|{s} <n> {s}|{s} <n>, {s}|{s} <n> <C> <p>|{s} <C> <n> - {s}|{s} <C> <n> <C> <p> {s}|<C> <n>   {s}|{w} <n> {s}|{w} <C> <n> {w}|<C> <a>~LOT #|<C> <a>~Lot ##|<C> <a>~Parcel ###|<C> <a>~{w}|<C> <n>~{w}|<C> <n>  {w}|{w}: <n>|{w} <C> <n>, {w}|<C> <n>|<C> <n>~<C> <p>|<C> <n>, <C> <p>|<C> <n>; <C> <n>|<C> <n>   <C> <n>|<C> <n> and <n>|<C> <n> / <n>|<C> <n> (<p>)|<C> <n> <<m>>|<C> <n>, <a>|<C> <n>~<a>|<C> <n>~<a>~{t} MD 2####|<C> <a>|<C> <a>, {t}|<C> <a>~{t}|<C> <a>, {t}, MD 2####|<C> <p>|<C> <p>   <C> <p>|<C> <m>|<C> <m>; <m>|<C> <m> or <C> <p>|<C> <i>|<i>|<C> <n>, <i>|<C> <n> / <i>|<i> {s}|{s} (<i>)|{s}: <i>|<C> <n> {s}|{s} <C> <n>|{s}, <C> <n>.|{s} <C> <a>, {s}|<C> <a> {s}|{s} <C> <p> {s}|{s} <C> <m>|<C> <n> {s}, <C> <p>|<C> <n> {s} <C> <m>|<C> <n> of <a>|{f}~<a>|{f}~<C> <p>|{f}, <a>|{f}~<a>, {t}|<C> <n> for {f}|<C> <n> on {r}|{s} - <C> <n> {s}|<C> <p> {s}, <C> <n>""".split("|")
NUMBERED = """Lot ##|LOT #|Lot: ###R|lots # and ##|Tax map ### parcel ####|TAX MAP: ##|Parcel ####|P. ####|Tax ID: ##-########|TAX ID ## - ########|District ## Account Number ########|District - ## Account Number - ########|Acct ##-########|Account Identifier: District - ## Account Number - ########|Scale 1" = ##'|SCALE # INCH = ## FEET|Ticket ########|Job ##-####|Job No. ##-####|Permit ###-##-####|Permit No. ######|Lic. No. #####|Prof. Lic. #####|Zip 2####-####|{t} MD 2####|{t}, MD 2####-####|Liber #### folio ###|Deed book #### page ###|Plat book ## page ##|Instrument ####-######|Inst. no. ########|Serial ########|S/N ########|Panel ####C####D|Elev. ###.##|HI ###.## BS #.## FS #.##|pt ### ok #.##|N ##°##'##" E ###.##'|N ## degrees ## minutes E ###.## feet|Area ###.## sq. ft.|#.## acres +/-|epoch ####.#|Rev # ##/##/####|Date: #/##/####|Sheet # of #|Ledger ##-####-##|Invoice ######|Case ##-####|Station ##+##.##|radius ###.## ft, chord ###.##|at #:## pm|$####.##|Setbacks ##/##/##|{r}, {t}|off {r}|along {r}|## feet east of {r}|Section # {d}|{d}|{d} Estates|{d}, Sec. #|{f}|{f}, {t}|north side of {r}|corner of {r} and {r}|{t}|{t} County|{w}|{w}|{w}|{w}, {w}|{w}: {w}|{w} - {w}|{w} ##|{w} #.##|{w}~{w}|Real estate search|Department of Records|Board of Appeals""".split("|")


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randrange(10)) if c == "#" else c for c in shape)


def _syllables(r: random.Random, least: int = 1, most: int = 2) -> str:
    return "".join(r.choice(ONSET) + r.choice(VOWEL) + (r.choice(CODA) if r.random() < 0.5 else "") for _ in range(r.randint(least, most)))


def _road(r: random.Random, full: bool = False) -> str:
    x = r.random()
    name = _syllables(r).capitalize() + r.choice(ROAD_END) if x < 0.7 else _syllables(r, 2, 3).capitalize() if x < 0.85 else r.choice(SURNAMES)
    head = f"{r.choice(DIRECTION[:7] if full else DIRECTION)} " if r.random() < 0.5 else ""
    return f"{head}{name} {r.choice(FULL_TYPE if full else ROAD_TYPE)}"


def _town(r: random.Random) -> str:
    one = _syllables(r).capitalize() + r.choice(ROAD_END)
    return r.choice([one, one, f"{one} {r.choice(['Mills', 'Point', 'Harbor', 'Landing', 'Neck', 'Run', 'Crossing', 'Park', 'Heights'])}", f"{r.choice(['Port', 'Lower', 'Upper', 'Fort', 'New'])} {one}", f"{r.choice(ADJ).capitalize()} {r.choice(NOUN).capitalize()}"])


def _firm(r: random.Random) -> str:
    word = lambda: r.choice([r.choice(NOUN).capitalize(), _syllables(r).capitalize(), r.choice(SURNAMES)])
    return f"{r.choice([word(), f'{word()} & {word()}', f'{word()} {word()}', f'{word()} and {word()}'])} {r.choice(FIRM_END)}"


def _words(r: random.Random) -> str:
    n, v, a, p = (lambda x: lambda: r.choice(x))(NOUN), (lambda x: lambda: r.choice(x))(VERB), (lambda x: lambda: r.choice(x))(ADJ), (lambda x: lambda: r.choice(x))(PLACE)
    s = r.choice([
        lambda: f"the {a()} {n()} {v()} {p()} the {n()}", lambda: f"{n()} and {n()} {v()}", lambda: f"{a()} {n()}, {v()}", lambda: f"{n()} {v()} {p()} {a()} {n()}", lambda: f"no {n()} {v()}", lambda: f"see {n()} {r.randrange(1, 20)}",
        lambda: f"about {n()} and the {a()} {n()}", lambda: f"{v()} the {n()} {p()} the {n()}", lambda: f"before {n()} is {v()}", lambda: f"{n()} {r.randrange(1, 400)}.{r.randrange(10)} ft {p()} {n()}", lambda: f"says the {n()} was {v()} in {r.randrange(1900, 2026)}",
    ])()
    return s[:1].upper() + s[1:] + r.choice(["", "."]) if r.random() < 0.6 else s


def _phrase(r: random.Random) -> str:
    """Two or three plain words, in any case: headings, remarks and names of things that are no persons."""
    s = r.choice([
        lambda: f"{r.choice(ADJ)} {r.choice(NOUN)}", lambda: f"{r.choice(NOUN)} {r.choice(NOUN)}", lambda: f"{r.choice(['her', 'his', 'their', 'my', 'our', 'your', 'a', 'the', 'this', 'no', 'each'])} {r.choice(NOUN)}{r.choice(['', 's', 's', 'es'])}",
        lambda: f"{r.choice(NOUN)} {r.choice(VERB)}", lambda: f"{r.choice(ADJ)} {r.choice(NOUN)} {r.choice(NOUN)}", lambda: f"{r.choice(VERB)} {r.choice(NOUN)}", lambda: f"{r.choice(NOUN)} {r.choice('ABCXYZ')}", lambda: f"{r.choice(NOUN)}, {r.choice(VERB)}", lambda: f"after {r.choice(['one', 'two', 'three', 'four', 'five', 'six', 'noon'])}, {r.choice(VERB)}",
        lambda: f"{r.choice(NOUN)} {_syllables(r, 1, 1).upper()}", lambda: f"{_syllables(r).capitalize()} {r.choice(NOUN)}",
    ])()
    return r.choice([s, s, s.upper(), s.upper(), s.capitalize(), s.capitalize(), s.capitalize(), s.title()])


def _title(r: random.Random) -> str:
    s = f"{r.choice(ADJ + NOUN)} {r.choice(NOUN)} {r.choice(['plan', 'plat', 'survey', 'permit', 'notes', 'sketch', 'sheet', 'layout', 'check', 'report', 'drawing', 'exhibit', 'location', 'profile', 'log'])}"
    return r.choice([s.upper(), s.title(), s.capitalize()])


def _case(line: str, r: random.Random) -> str:
    """A line with its words filled in and a cue of the next item before each item."""
    out = ""
    while "<C>" in line:
        before, _, line = line.partition("<C>")
        item = line.lstrip()[1:2]
        out += before + r.choice(CUE.get(item, [""]))
    line = out + line
    for mark, make in (("{r}", lambda: _road(r, r.random() < 0.6)), ("{t}", lambda: _town(r)), ("{f}", lambda: _firm(r)), ("{d}", lambda: _title(r)), ("{w}", lambda: _phrase(r)), ("{s}", lambda: _words(r) if r.random() < 0.7 else _phrase(r))):
        while mark in line:
            line = line.replace(mark, make(), 1)
    return line.strip(" ,")


def _typo(r: random.Random, s: str) -> str:
    at = r.randrange(1, max(2, len(s) - 1))
    kind = r.randrange(4)
    if kind == 0:
        return s[:at] + s[at + 1 :]
    if kind == 1:
        return s[:at] + s[at] + s[at:] if at < len(s) else s
    if kind == 2 and at + 1 < len(s):
        return s[:at] + s[at + 1] + s[at] + s[at + 2 :]
    return s[:at] + r.choice("aeiounrstlm ") + s[at + 1 :]


def _surname(r: random.Random) -> str:
    x = r.random()
    s = r.choice(SURNAMES) if x < 0.2 else _syllables(r, 1, 2).capitalize() + r.choice(["", "", "e", "o", "er", "en", "ow", "a"]) + r.choice(SUR_END) if x < 0.85 else _syllables(r, 2, 3).capitalize()
    return _typo(r, s).replace(" ", "e") if r.random() < 0.08 else s


def _given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.65 else _syllables(r, 1, 2).capitalize() + r.choice(["", "a", "e", "o", "ie", "in", "us"])


def _name(r: random.Random) -> str:
    sur = _surname(r)
    if r.random() < 0.08:
        sur += "-" + _surname(r)
    given = _given(r) if r.random() < 0.85 else f"{r.choice('ABCDEFGHIJKLMNOPRSTVWZ')}."
    middle = f" {r.choice('ABCDEFGHIJKLMNOPRSTW')}." if r.random() < 0.2 and len(given) > 2 else ""
    suffix = r.choice([" Jr.", " Sr.", " III", " II", " IV", ", Jr."]) if r.random() < 0.07 else ""
    if r.random() < 0.17:
        s = f"{sur}, {given}{middle}"
    else:
        s = f"{given}{middle} {sur}{suffix}"
    x = r.random()
    return s.upper() if x < 0.2 else s.lower() if x < 0.26 else s


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, f"{r.randrange(2, 10)}##"), "555", _digits(r, "01##")
    if r.random() < 0.3:
        b, c = _digits(r, f"{r.randrange(2, 10)}##"), _digits(r, "####")
    s = r.choice([f"({a}) {b}-{c}"] * 4 + [f"{a}-{b}-{c}"] * 3 + [f"{a}.{b}.{c}"] * 2 + [f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}{b}{c}", f"{a} {b}-{c}", f"{a}/{b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}"])
    if r.random() < 0.1:
        s = r.choice([f"+44 1632 960 {_digits(r, '###')}", f"01632 960{_digits(r, '###')}", f"+49 30 {_digits(r, '########')}", f"+44 {_digits(r, '####')} {_digits(r, '######')}", f"0{_digits(r, '####')} {_digits(r, '######')}"])
    return s + (r.choice([" x##", " ext. ###", " ext ##", " x###"]).replace("#", "7") if r.random() < 0.14 else "")


def _mail(r: random.Random) -> str:
    plain = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalpha()) or "x"
    given, sur = plain(_given(r)), plain(_surname(r))
    local = r.choice([f"{given}.{sur}", f"{given[0]}{sur}", f"{sur}-{given[0]}", f"{sur}{r.randrange(100)}", f"lot{r.randrange(120)}{given}", f"{given}+plans", f"{given}_{sur[0]}", sur, f"{r.randrange(10)}{r.choice('0t')}{r.randrange(100)}{given}"])
    part = r.choice(DOMAIN) if r.random() < 0.5 else plain(_syllables(r))
    host = f"{part}{r.choice(['', '', '-' + r.choice(DOMAIN), r.choice(DOMAIN)])}.{r.choice(HOST_END)}"
    x = r.random()
    if x < 0.1:
        s = f"{local} [at] {host.replace('.', ' [dot] ')}"
    elif x < 0.16:
        s = f"{local}(at){host}"
    elif x < 0.22:
        s = f"{local} @ {host}"
    elif x < 0.24:
        s = f"{local} at {host.replace('.', ' dot ')}"
    else:
        s = f"{local}@{host}"
    return s.upper() if r.random() < 0.15 else s


def _identity(r: random.Random) -> tuple[str, str]:
    ssn = r.choice(["666", _digits(r, "9##"), _digits(r, "###")])
    plain = r.choice([f"{ssn}-{_digits(r, '##-####')}"] * 3 + [f"{ssn} {_digits(r, '## ####')}", f"{ssn}{_digits(r, '######')}"])
    x = r.random()
    if x < 0.5:
        return r.choice(["SSN ", "SSN: ", "Soc. Sec. No. ", "S.S. ", "social security ", "social security #", "soc sec ", "SS# ", "social ", "", "SSN ", ""]), plain
    if x < 0.67:
        return r.choice(["passport ", "Passport No. ", "pass. nr ", "passport no. "]), r.choice("ABCKLMNPQRSTXZ") + _digits(r, "########")
    if x < 0.83:
        letter = r.choice("ABCGHKLMSTW")
        return r.choice(["Oper. Lic. ", "driver's lic. ", "DL ", "Driver license no. ", "driver lic # ", "D.L. no. ", "licence to drive "]), letter + r.choice([_digits(r, "-###-###-###-###"), _digits(r, "############"), _digits(r, " ### ### ### ###")])
    return r.choice(["resident card ", "alien reg. no. ", "ID card no. ", "resident no. "]), r.choice(["A" + _digits(r, "#########"), _digits(r, "##-####-####")])


def _address(r: random.Random) -> str:
    s = f"{r.randrange(1, 4200)} {_road(r)}"
    if r.random() < 0.12:
        s += r.choice([" #3", " #B", " Apt 2", ", Apt. 4", ", Unit A", " Unit 12", ", Suite 3B", ", Suite 210", " apt. 1", ", Ste 5"])
    if r.random() < 0.1:
        number, rest = s.split(" ", 1)
        s = f"{number} {_typo(r, rest)}"
    x = r.random()
    return s.upper() if x < 0.15 else s.lower() if x < 0.22 else s


#: How a scanner misreads single characters.
MISREAD = {"0": "Oo", "1": "lI", "5": "Ss", "8": "B", "o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "S": "5", "s": "5", "e": "3", "E": "3", "a": "@", "t": "+", "B": "8", "d": "o", "g": "6", "c": "o"}


def write(r: random.Random) -> tuple[str, np.ndarray]:
    """A text and its tag per character."""
    chars: list[str] = []
    tags: list[int] = []

    def put(s: str, kind: str | None = None) -> None:
        for k, c in enumerate(s):
            chars.append(c)
            tags.append(0 if kind is None else TAGS.index(("B-" if k == 0 else "I-") + kind))

    put(_title(r))
    for _ in range(r.randrange(5, 20)):
        put(r.choice(["\n"] * 6 + ["  "]))
        y = r.random()
        line = r.choice(WITH) if y < 0.55 else r.choice(NUMBERED) if y < 0.85 else "{s}" if y < 0.93 else f"{r.choice(NUMBERED)}{r.choice([', ', '  ', ' - '])}{{s}}"
        line = _case(line, r).replace("~", "\n")
        x = r.random()
        case = str.upper if x < 0.13 else str.lower if x < 0.16 else str
        at = 0
        while at < len(line):
            if line[at] == "<" and line[at + 1 : at + 2] in set("npmia") and line[at + 2 : at + 3] == ">":
                letter = line[at + 1]
                if letter == "i":
                    cue, value = _identity(r)
                    put(case(cue))
                    kind = "id_number"
                else:
                    value, kind = {"n": (_name, "person_name"), "p": (_phone, "phone"), "m": (_mail, "email"), "a": (_address, "street_address")}[letter][0](r), {"n": "person_name", "p": "phone", "m": "email", "a": "street_address"}[letter]
                if case is str.upper and r.random() < 0.5:
                    value = value.upper()
                if " " in value and r.random() < 0.06:
                    spot = r.choice([i for i, c in enumerate(value) if c == " "])
                    value = value[:spot] + "\n" + value[spot + 1 :]
                put(value, kind)
                at += 3
            else:
                c = line[at]
                put(case(str(r.randrange(10)) if c == "#" else c))
                at += 1
    rate = r.choice([0, 0, 0, 0.01, 0.03, 0.08])
    if rate:
        for i, c in enumerate(chars):
            if c in MISREAD and r.random() < rate:
                chars[i] = r.choice(MISREAD[c])
    if r.random() < 0.2:
        put("  ")
    return "".join(chars), np.array(tags, dtype=np.int8)


def batch(r: random.Random, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` characters: letter ids, class ids, tags."""
    a, b, c = (np.zeros((size, width), dtype=np.int64) for _ in range(3))
    row = 0
    while row < size:
        text, tags = write(r)
        for at in range(r.randrange(0, 40), max(1, len(text) - width), width):
            if row >= size:
                break
            part = text[at : at + width]
            if len(part) < width:
                break
            a[row] = [letter_id(x) for x in part]
            b[row] = [char_class(x) for x in part]
            y = tags[at : at + width].astype(np.int64)
            c[row] = y
            row += 1
    return a, b, c


def start_weights(hidden: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for way in "fb":
        w[f"letter_{way}"] = rng.normal(0, 0.15, (LETTERS, 4 * hidden))
        w[f"class_{way}"] = rng.normal(0, 0.15, (CLASSES, 4 * hidden))
        w[f"rec_{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0
        w[f"bias_{way}"] = bias
        w[f"out_{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, len(TAGS)))
    w["out_bias"] = np.zeros(len(TAGS))
    w["trans"] = np.zeros((len(TAGS), len(TAGS)))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w: dict[str, np.ndarray], way: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    n, steps = a.shape
    hidden = w[f"rec_{way}"].shape[0]
    x = w[f"letter_{way}"][a.T] + (w[f"class_{way}"] + w[f"bias_{way}"])[b.T]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    hs, cs, gates = np.zeros((steps + 1, n, hidden), np.float32), np.zeros((steps + 1, n, hidden), np.float32), np.zeros((steps, n, 4 * hidden), np.float32)
    order = range(steps) if way == "f" else range(steps - 1, -1, -1)
    for k, t in enumerate(order):
        z = x[t]
        z += h @ w[f"rec_{way}"]
        z[:, : 3 * hidden] *= 0.5
        np.tanh(z, out=z)
        z[:, : 3 * hidden] += 1
        z[:, : 3 * hidden] *= 0.5
        i, f, o, g = z[:, :hidden], z[:, hidden : 2 * hidden], z[:, 2 * hidden : 3 * hidden], z[:, 3 * hidden :]
        c = f * c + i * g
        h = o * np.tanh(c)
        hs[k + 1], cs[k + 1], gates[k] = h, c, z
    return hs, {"cs": cs, "gates": gates}


def step(w: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood per character and its gradient (back-propagation through time; CRF by forward-backward)."""
    n, steps = a.shape
    k = len(TAGS)
    g = {name: np.zeros_like(v) for name, v in w.items()}
    hs, kept = {}, {}
    emit = np.tile(w["out_bias"], (steps, n, 1)).astype(np.float32)
    for way in "fb":
        hs[way], kept[way] = _forward(w, way, a, b)
        out = hs[way][1:] @ w[f"out_{way}"]
        emit += out if way == "f" else out[::-1]
    trans = w["trans"]
    move = np.exp(trans)
    top = emit.max(axis=2, keepdims=True)
    likely = np.exp(emit - top)
    alpha, beta, norm = np.empty_like(likely), np.empty_like(likely), np.empty((steps, n, 1), np.float32)
    for t in range(steps):
        x = likely[t] if t == 0 else (alpha[t - 1] @ move) * likely[t]
        norm[t] = x.sum(axis=1, keepdims=True)
        alpha[t] = x / norm[t]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = ((likely[t + 1] * beta[t + 1]) @ move.T) / norm[t + 1]
    whole = (np.log(norm) + top).sum(axis=(0, 2))
    yt = y.T
    times, rows = np.arange(steps)[:, None], np.arange(n)[None, :]
    gold = emit[times, rows, yt].sum() + trans[yt[:-1], yt[1:]].sum()
    scale = 1.0 / (n * steps)
    d_emit = alpha * beta
    ahead = (likely * beta / norm)[1:].reshape(-1, k)
    g["trans"] += move * (alpha[:-1].reshape(-1, k).T @ ahead)
    np.add.at(g["trans"], (yt[:-1].ravel(), yt[1:].ravel()), -1)
    d_emit[times, rows, yt] -= 1
    d_emit = (d_emit * scale).astype(np.float32)
    g["trans"] *= scale
    g["out_bias"] += d_emit.sum(axis=(0, 1))
    for way in "fb":
        hidden = w[f"rec_{way}"].shape[0]
        d_out = d_emit if way == "f" else d_emit[::-1]
        g[f"out_{way}"] += hs[way][1:].reshape(-1, hidden).T @ d_out.reshape(-1, k)
        d_hs = d_out @ w[f"out_{way}"].T
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        dz_all = np.zeros((steps, n, 4 * hidden), np.float32)
        cs, gates = kept[way]["cs"], kept[way]["gates"]
        for s in range(steps - 1, -1, -1):
            dh = dh + d_hs[s]
            i, f, o, gg = gates[s][:, :hidden], gates[s][:, hidden : 2 * hidden], gates[s][:, 2 * hidden : 3 * hidden], gates[s][:, 3 * hidden :]
            tc = np.tanh(cs[s + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * cs[s] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            dz_all[s] = dz
            dh = dz @ w[f"rec_{way}"].T
            dc = dc * f
        g[f"rec_{way}"] += hs[way][:-1].reshape(-1, hidden).T @ dz_all.reshape(-1, 4 * hidden)
        g[f"bias_{way}"] += dz_all.sum(axis=(0, 1))
        flat = (dz_all if way == "f" else dz_all[::-1]).reshape(-1, 4 * hidden)
        for name, ids, size in ((f"letter_{way}", a, LETTERS), (f"class_{way}", b, CLASSES)):
            one = np.zeros((size, flat.shape[0]), np.float32)
            one[ids.T.reshape(-1), np.arange(flat.shape[0])] = 1
            g[name] += one @ flat
    return float((whole.sum() - gold) * scale), g


def _worker(pipe, seed: int, size: int, width: int) -> None:  # type: ignore[no-untyped-def]
    r = random.Random(seed)
    mean: dict[str, np.ndarray] = {}
    square: dict[str, np.ndarray] = {}
    count = 0
    while (got := pipe.recv()) is not None:
        w, steps, rate = got
        if not mean:
            mean, square = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        loss = 0.0
        for _ in range(steps):
            value, g = step(w, *batch(r, size, width))
            loss += value / steps
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            count += 1
            for k in w:
                x = g[k] * clip
                mean[k] = 0.9 * mean[k] + 0.1 * x
                square[k] = 0.99 * square[k] + 0.01 * x * x
                w[k] = w[k] - rate * (mean[k] / (1 - 0.9**count)) / (np.sqrt(square[k] / (1 - 0.99**count)) + 1e-7)
        pipe.send((w, loss))


def train(seconds: float, workers: int, hidden: int = 40, size: int = 64, width: int = 140, every: int = 10, warm: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    w = warm or start_weights(hidden)
    ends = []
    for k in range(workers):
        mine, theirs = Pipe()
        Process(target=_worker, args=(theirs, int(time.time()) + 1000 * k if warm else 77 + k, size, width), daemon=True).start()
        ends.append(mine)
    began, n = time.time(), 0
    while (part := (time.time() - began) / seconds) < 1:
        rate = (3e-3 if warm else 6e-3) * min(1, (n + 1) / 5) * (0.5 * (1 + np.cos(np.pi * part)) + 0.02)
        for e in ends:
            e.send((w, every, rate))
        got = [e.recv() for e in ends]
        w = {k: np.mean([g[0][k] for g in got], axis=0) for k in w}
        n += 1
        if n % 10 == 0:
            print(n * every, round(time.time() - began), "loss", round(float(np.mean([g[1] for g in got])), 5), flush=True)
    for e in ends:
        e.send(None)
    return w


if __name__ == "__main__":
    old = dict(np.load(sys.argv[4])) if len(sys.argv) > 4 else None
    model = train(float(sys.argv[2]), int(sys.argv[3]), warm={k: v.astype(np.float32) for k, v in old.items()} if old else None)
    np.savez_compressed(sys.argv[1], **{k: v.astype(np.float16) for k, v in model.items()})
