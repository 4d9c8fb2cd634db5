"""Scores for abusive, hateful or sexually explicit language by weak supervision.

Words are put into classes (insults, persons, groups of people, violence, sex, things of the trade, ...) by general lexicons of four
languages; voters are rules on where words of these classes stand to one another. Every sentence of every document gets their votes:
offensive, harmless, or none. A generative label model estimates, without labels but for the few examples, the share of offensive
sentences, how often each voter fires on either class, and which voters depend on one another (a tree over the voters, fitted by
expectation-maximisation to the counts of all vote patterns of the corpus). Its posteriors label a bounded sample of sentences per
vote pattern; on these a linear classifier over hashed words, word pairs and votes is trained. A document's score is the highest
score among its sentences; a stretch without a sentence's end is scored in overlapping windows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

# The lexicons of the voters, in plain letters without accents; "*" stands for any ending, "_" joins words of a phrase.
LEXICON = {
    "insult": """asshole* arsehole* dickhead* moron* cretin* idiot* imbecile* dipshit* shithead* loser* scum scumbag* clown* liar* worm* cow* hag* crook* bastard* creep* jerk* bitch* whore* slut* cunt* prick* twat*
        wanker* retards retarded pig* swine douche* thief thieves parasite* vermin filth trash garbage fool* motherfucker* fucker* dumbass* jackass* coward* pervert* freak* weasel* leech* hypocrite* halfwit* nitwit* dolt* dunce* buffoon*
        skank* hooker* piece_of_shit piece_of_crap piece_of_garbage piece_of_trash piece_of_filth piece_of_dirt half_a_brain excuse_for_a
        basura imbecil* idiota* cabron* gilipollas estupid* inutil* ladron* puta puto putas mierda pendej* maricon* zorra* payaso* cerdo* mentiros* asqueros* malnacid*
        arschloch* versager* drecksau* vollidiot* schlampe* hurensohn* elend* lugner* wichser* miststuck* drecks* depp* trottel* penner* fotze* hure* schwein* abschaum scheiss*
        connard* connasse* salaud* salope* merde* minable* ordure* encule* abruti* voleur* menteur* pute putes batard* debile* raclure*""",
    "nasty": """pathetic useless worthless ugly brainless disgusting lying filthy stinking miserable spineless dirty fat fucking goddamn damn* bloody effing rotten stupid dumb* incompetent lazy greedy nasty sneaky crooked
        maldit* dumm* blod* verdammt* sale pauvre stupide*""",
    "foul": """fuck* shit* crap ass arse piss* hell screw* sod bugger* effing joder chinga* scheiss* fick* foutre putain nique*""",
    "you": """you your yours yourself yourselves u ya tu te ti tus eres dich dir dein* ihr toi ton ta tes vous votre""",
    "me": """i me my myself mi yo ich mich mir mein* je moi mon ma""",
    "person": """he she him her his they them their man woman men guy girl boy wife husband boss clerk* inspector* surveyor* crew firm neighbor* neighbour* lady people everyone everybody nobody owner* driver* engineer* secretary chief""",
    "wish": """hope* wish* deserve* should ought better ojala hoffentlich espero""",
    "will": """will ll would going gonna swear promise* ought voy vais werde""",
    "violence": """kill* burn* bury break smash* shoot* hurt beat stab* hang strangle* drown* punch* slap* cut bullet axe knife hammer rape* choke* bleed* whip crush destroy slit throat teeth skull bones bludgeon club
        matar* romper* pegar* quemar* golpe* schlag* umbring* bring* brech* tote* zunde* tuer casser frapper bruler egorge*""",
    "death": """die dies dying dead choke* rot rots burn* drown* suffer* bleed* bury coffin grave ambulance hearse hospital mueras muera pudra* caiga verreck* sterb* krepier* creve* crever mourir""",
    "stalk": """sleep* live lives kids school children family back house""",
    "know": """know where which find watch accidents accident""",
    "shut": """shut kiss lick suck bite eat shove stick crawl callate vete jodete verpiss* halt hau leck ferme casse degage va""",
    "begone": """drop_dead get_lost go_to_hell piss_off fuck_off f_off sod_off screw_you shut_up eat_shit kill_yourself hau_ab va_te vete_a fous_le_camp""",
    "rude": """up off mouth face lost trap butt boots rock sun smell* mother yourself fresse klappe gueule boca infierno culo dead""",
    "group": """immigrant* migrant* refugee* foreigner* gay gays lesbian* homosexual* women jews jew jewish muslim* christian* catholic* blacks whites asians arabs mexicans gypsies newcomer* velkari cripple* natives tribe
        old_people disabled_people gay_people poor_people black_people white_people those_people that_religion that_faith their_kind your_kind that_kind their_sort this_sort the_disabled the_poor people_like_that people_like_them
        inmigrante* extranjero* refugiado* mujeres gitano* judio* moros fluchtling* auslander* frauen zigeuner* schwule* juden etranger* immigre* refugie* femmes gitan* juif* arabes""",
    "low": """breed* rats rat animals vermin plague disease* thieves parasite* savage* stupid stink* sickness filth cockroach* subhuman criminal* worthless inferior infect* infest* dirty apes monkeys dogs pigs less_than_people ruin* steal* lazy blood
        cannot_think cannot_survey cannot_even cannot_measure cannot_drive plaga roban animales ratas basura sirven ungeziefer dumm* stink* vermine sauvage* voleurs animaux betes incapables envahi*""",
    "out": """driven rounded_up locked_up deport* banned kick* throw send back_where kept_off out_of_here no_place other_side not_welcome not_belong deserve* through_the_door get_out deal_with ditches kitchen
        echarlos fuera vayan calladas cocina weggesperrt verschwinden raus abgeschoben herd kuche dehors chez_eux rien_a_faire cuisine""",
    "us": """us we our ours""",
    "them": """they them those""",
    "sexual": """tits tit boobs boob titties horny porn* hardcore topless blowjob* orgasm* pussy dildo* nympho* milf* striptease xxx sexy erotic* masturbat* cumming moaning slutty lapdance nympho* escort_service call_girl* undressed
        desnuda* desnudo* tetas coger follar* nacktbild* ficken titten geil seins baiser culotte""",
    "intimate": """naked nude* undress* kiss* lick* breast* underwear panties bra blouse lingerie moan* make_love sex sexual sexually tongue motel babe uncut uncensored singles on_top in_bed my_bed between_your
        sleep_with fuck* ropa cama nackt* im_bett ausziehen nue nues coucher deshabill* lecher schlafen""",
    "body": """skin touch* ride rode came lap legs thighs scream* horny hard wet hot lust dream* mouth lips screw* sleep baby begging adult take_off arms eyes hands lonely suenos sueno zieh lit crier envie culo ass""",
    "lure": """free click videos video pictures pics photos movies cams models singles tonight fotos bilder night noche nacht soir""",
    "not": """not no never nobody without do_not dont doesnt didnt wont wouldnt neither nor none""",
    "say": """call* complain* report* ask* said says say remark* language tell telling mention* shout* heard word words article policy""",
    "feel": """feel feels felt feeling was am were""",
    "farm": """puppy puppies kitten* litter kennel* barn* pasture* herd* cattle milk hay stable* hen hens chicken* fox foxes bait* mule* cart sheep goat* dog dogs cat cats rats rat mice bird* deer""",
    "thing": """file cut clay bank gate pin bend test switch height diameter tripod rod tape pipe stake* stone* wall fence ditch culvert drain well septic sewer pump line lot parcel feet foot ft inch inches acres degrees minutes road bridge
        spillway dam blasting shaft deck fee table map offset hub nail rebar cap monument corner bearing* elevation benchmark concrete gravel trench pile piles plan plat sheet permit deed survey easement zoning driveway garage porch shed
        boundary contour datum level backsight transit chain axle oak tree trees creek marsh pond meadow frost snow rain""",
}
#: The voters; a name with "no_" at the front votes harmless, every other one offensive.
VOTERS = [
    "insult_you", "insult_person", "insult_call", "insult_twice", "foul_you", "shut", "threat", "death_wish", "stalking", "group_low", "group_out", "group_short", "them_us", "sexual", "intimate_two", "intimate_you", "lure",
    "no_negated", "no_self", "no_thing", "no_trade", "no_plain",
]
HARMLESS = [name.startswith("no_") for name in VOTERS]
LOUD = sum(1 << j for j, h in enumerate(HARMLESS) if not h)

BITS = 1 << 17
PER_PATTERN = 250
PER_QUIET_PATTERN = 2_500
MOST_PATTERNS = 1 << 16
TAUGHT_PATTERNS = 2_048
MOST_EXAMPLES = 20_000
SENTENCES_KEPT = 100_000
WORDS_KEPT = 200_000
LONGEST, OVERLAP = 600, 200
THRESHOLD = 0.6

_ENDS = re.compile(r"(?<=[.!?;…])[\s\"'”»)]+|[\r\n\x0b\x0c\u2028\u2029]+")
_DOTTED = re.compile(r"\b(?:[^\W\d_][.\-*_·•]){2,}[^\W\d_]\b")
_SPACED = re.compile(r"\b(?:[^\W\d_] ){3,}[^\W\d_]\b")
_STRETCH = re.compile(r"(.)\1{2,}")
_BLOT = re.compile(r"[a-z]+[*#_%][a-z*#_%0-9+@$!]*")
_LEET = str.maketrans("013457@$!|+", "oleastasilt")
_MIXED = re.compile(r"(?=[a-z0-9@$!|+]*[a-z])(?=[a-z0-9@$!|+]*[0-9@$!|+])[a-z0-9@$|!+]{3,}(?<![!])")
_ODD = re.compile(r"[^a-z ,.]")
_WORDS = re.compile(r"[a-z]+|\d+|,")


def _entries() -> tuple[dict[str, int], list[tuple[str, int]], dict[str, int]]:
    exact: dict[str, int] = {}
    starts: list[tuple[str, int]] = []
    phrases: dict[str, int] = {}
    for k, text in enumerate(LEXICON.values()):
        for entry in text.split():
            if entry.endswith("*"):
                starts.append((entry[:-1], 1 << k))
            else:
                into = phrases if "_" in entry else exact
                key = entry.replace("_", " ")
                into[key] = into.get(key, 0) | 1 << k
    return exact, starts, phrases


_EXACT, _STARTS, _PHRASES = _entries()
#: Second words of the phrases by their first word.
_PHRASE_HEADS: dict[str, set[str]] = {}
for _phrase in _PHRASES:
    _PHRASE_HEADS.setdefault(_phrase.split()[0], set()).add(_phrase.split()[1])
CLASS = {name: 1 << k for k, name in enumerate(LEXICON)}
#: Words looked up for tokens in which single letters are blotted out.
_BLOTTED = sorted({w for name in ("insult", "nasty", "foul", "sexual", "intimate") for e in LEXICON[name].split() if "_" not in e and len(w := e.rstrip("*")) > 3})
SENSES = sum(CLASS[k] for k in ("insult", "nasty", "foul", "violence", "death", "shut", "low", "sexual", "intimate", "body"))
ANIMALS = {"bitch", "bitches", "cow", "cows", "pig", "pigs", "swine", "worm", "worms", "leech", "leeches", "vermin", "parasite", "parasites", "ass", "rat", "rats", "dogs", "animals", "weasel", "weasels"}
_ARTICLES = {"a", "an", "such", "what", "which", "only", "that", "the", "of", "un", "une", "ein", "una", "espece", "pedazo"}
#: What may stand between "I am" or "I feel" and the word that the speaker has for himself, and verbs that give somebody a name.
_SELF, _BEING = {"i", "im", "ich", "je", "yo"}, {"am", "was", "be", "feel", "felt", "look", "looked", "sound", "sounded", "bin", "war", "suis", "soy", "fui"}
_FILLERS = {"like", "as", "such", "so", "quite", "really", "very", "just", "still", "always", "complete", "total", "bit", "of", "a", "an", "the", "un", "une", "una", "ein", "como", "comme", "wie"}
_NAMING = {"call", "calls", "called", "calling", "name", "named", "label", "labelled", "labeled", "brand", "branded"}
STRONG = sum(CLASS[k] for k in ("insult", "nasty", "foul", "violence", "death", "shut", "begone", "group", "low", "sexual", "intimate", "body", "us", "stalk"))


@lru_cache(maxsize=4096)
def _names(mask: int) -> tuple[str, ...]:
    return tuple(name for name, bit in CLASS.items() if mask & bit)


@lru_cache(maxsize=WORDS_KEPT)
def word_classes(word: str) -> int:
    """Bits of the classes a word belongs to."""
    mask = _EXACT.get(word, 0)
    for start, bit in _STARTS:
        if word.startswith(start) and len(word) <= len(start) + 5:
            mask |= bit
    return mask


def _unblot(m: re.Match[str]) -> str:
    token = m[0]
    shape = re.compile("".join("[a-z]" if c in "*#_%" else re.escape(c.translate(_LEET)) for c in token) + r"\Z")
    for tail in ("", "s", "ed", "ing"):
        for word in _BLOTTED:
            if len(word) + len(tail) == len(token) and shape.match(word + tail):
                return word + tail
    return token


def _joined(m: re.Match[str]) -> str:
    """Letters parted by blanks as a word; an article before them stays a word of its own."""
    word = m[0].replace(" ", "")
    return f"{word[0]} {word[1:]}" if word[0] in "ai" and not word_classes(word) and word_classes(word[1:]) else word


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; none for an empty or null one. A stretch of more than ``LONGEST`` characters without an end comes as
    overlapping windows, so that every part of it is judged and no unit is unbounded."""
    out: list[str] = []
    for s in _ENDS.split(text) if text else []:
        if len(s) <= LONGEST:
            if s := s.strip():
                out.append(s)
        else:
            out += [w for at in range(0, len(s) - OVERLAP, LONGEST - OVERLAP) if (w := s[at : at + LONGEST].strip())]
    return out


def plain(sentence: str) -> str:
    """Lower case without accents, disguises undone (letters parted by dots or blanks, digits for letters, stars, stretched letters), words and commas only."""
    s = sentence.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("’", "'"))
        s = "".join(c for c in s if not unicodedata.combining(c))
    if _ODD.search(s):
        s = _DOTTED.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), s)
        s = _BLOT.sub(_unblot, s)
        s = _MIXED.sub(lambda m: m[0].translate(_LEET) if not m[0].isdigit() else m[0], s)
        s = s.replace("'", "")
    else:
        s = _DOTTED.sub(lambda m: m[0].replace(".", ""), s)
    s = _SPACED.sub(_joined, s)
    s = _STRETCH.sub(r"\1", s)
    return " ".join(_WORDS.findall(s))


def spared(w: list[str], place: list[int], kinds: list[int]) -> tuple[list[int], list[int]]:
    """Strong words that are meant for nobody: those that the speaker has for himself ("I feel like an idiot"), and denied ones, be it the
    name that nobody is to be given ("do not call him a liar") or the harm in a wish that it may not come ("hopes she does not choke")."""
    of_self: list[int] = []
    denied: list[int] = []
    no, nasty = CLASS["not"], CLASS["nasty"]
    for j in range(1, len(w)):
        if kinds[j] & CLASS["insult"]:
            # back over the words of one clause that may lead up to the insult
            i = j - 1
            while i > 0 and (w[i] in _FILLERS or kinds[i] & nasty) and place[i + 1] - place[i] == 1:
                i -= 1
            if place[j] - place[i] == j - i and (w[i] == "im" or w[i] in _BEING and i > 0 and w[i - 1] in _SELF and place[i] - place[i - 1] == 1):
                of_self.append(j)
            if w[j - 1] in ("a", "an") or kinds[j - 1] & nasty and j > 1 and w[j - 2] in ("a", "an"):
                denied += [j for k in range(max(1, j - 7), j - 1) if w[k] in _NAMING and place[j] - place[k] == j - k and any(kinds[x] & no for x in range(max(0, k - 2), k))][:1]
        if kinds[j] & CLASS["death"] and kinds[j - 1] & no and place[j] - place[j - 1] == 1 and any(kinds[i] & CLASS["wish"] for i in range(max(0, j - 10), j - 1)):
            denied.append(j)
    return of_self, denied


def votes(words: str) -> int:
    """Bit j set where voter j votes; the last voter votes harmless where no word of a strong class stands. A comma parts words as
    three words between them would."""
    w: list[str] = []
    place: list[int] = []
    gap = 0
    for x in words.split():
        if x == ",":
            gap += 3
        else:
            place.append(len(w) + gap)
            w.append(x)
    if not w:
        return 1 << (len(VOTERS) - 1)

    def _near(a: list[int], b: list[int], before: int, after: int) -> bool:
        """Some word of ``b`` stands at most ``before`` words before or ``after`` words after one of ``a``."""
        return any(-before <= place[y] - place[x] <= after and x != y for x in a for y in b)

    kinds = [word_classes(x) for x in w]
    for i, x in enumerate(w):
        if (after := _PHRASE_HEADS.get(x)) and i + 1 < len(w) and w[i + 1] in after:
            for n in (2, 3, 4):
                if found := _PHRASES.get(" ".join(w[i : i + n])):
                    kinds[i] |= found
    if not any(k & STRONG for k in kinds):
        return 1 << (len(VOTERS) - 1)
    # a strong word right before a thing tells of the thing, and an animal among others of the farm of the animal, not of a person
    of_thing = [i for i in range(len(w) - 1) if kinds[i] & SENSES and kinds[i + 1] & CLASS["thing"]]
    if any(x in ANIMALS for x in w):
        beasts = {x for x, k in zip(w, kinds, strict=True) if k & CLASS["farm"]}
        of_thing += [i for i, x in enumerate(w) if x in ANIMALS and kinds[i] & SENSES and beasts - {x}]
    of_self, denied = spared(w, place, kinds)
    for i in (*of_thing, *of_self, *denied):
        kinds[i] &= ~SENSES
    at: dict[str, list[int]] = {name: [] for name in CLASS}
    for i, k in enumerate(kinds):
        for name in _names(k):
            at[name].append(i)
    you, me, person = at["you"], at["me"], at["person"]
    close = [*you, *me, *(i for i in person if w[i] in ("he", "she", "him", "her", "his"))]
    insult, nasty, foul, group = (at[k] for k in ("insult", "nasty", "foul", "group"))
    harsh = sorted({*insult, *nasty})
    last = len(w) - 1
    fires = {
        "insult_you": _near(insult, you, 7, 6),
        "insult_person": _near(insult, person, 8, 3) and not you,
        "insult_call": any(i == last or i <= 1 for i in insult) and (bool(you) or bool(nasty) or 1 < len(w) <= 8) or any(w[max(0, j - 1)] in _ARTICLES or kinds[j - 1] & CLASS["nasty"] and w[j - 2] in _ARTICLES for j in insult if j > 1),
        "insult_twice": any(b - a == 1 for a, b in zip(harsh, harsh[1:], strict=False)) and bool(insult) or len(set(harsh)) >= 3,
        "foul_you": any(j - i in (1, 2) and (w[j] in ("off", "you", "your", "yourself", "u") or j in you) for i in foul for j in range(i + 1, min(i + 3, len(w)))),
        "shut": bool(at["begone"]) or _near(at["shut"], [*at["rude"], *(i for i in me if w[i] in ("me", "my"))], 0, 3) or _near(at["shut"], you, 0, 1) and _near(at["shut"], at["rude"], 0, 12) or any(w[i] in ("smell", "mother") and _near([i], you, 2, 2) for i in at["rude"]),
        "threat": _near(at["violence"], at["will"], 6, 0) and (bool(you) or _near(at["violence"], person, 0, 8)) or _near(at["violence"], [i for i in you if w[i] in ("dir", "dich", "te", "yourself")], 3, 3),
        "death_wish": _near(at["death"], [*at["wish"], *at["will"]], 6, 6) and bool(you or person) or _near(at["death"], [i for i in you if w[i] != "te"], 6, 3) and len(w) <= 16 or any(w[i] in ("creve", "verreck", "crever") for i in at["death"]),
        "stalking": _near(at["stalk"], you, 3, 2) and bool(at["know"]) and bool(me or at["death"] or "watch" in w),
        "group_low": _near(group, [*at["low"], *at["violence"]], 12, 12),
        "group_out": _near(group, at["out"], 10, 10),
        "group_short": bool(group) and len(w) <= 5 and w[0] in ("no", "keine", "pas", "not"),
        "them_us": bool(at["us"]) and bool(at["them"]) and len(w) <= 10 and not at["thing"],
        "sexual": bool(at["sexual"]),
        "intimate_two": len({w[i] for i in (*at["intimate"], *at["body"])}) >= 2 and _near([*at["intimate"], *at["body"]], close, 4, 4),
        "intimate_you": _near(at["intimate"], [*you, *(i for i in close if w[i] in ("her", "him"))], 4, 6),
        "lure": bool(at["sexual"] or at["intimate"]) and len({w[i] for i in at["lure"]}) >= 2,
        "no_negated": _near([*insult, *foul, *at["violence"], *at["low"]], at["not"], 5, 0) and bool(at["say"]) or _near([*insult, *at["violence"], *foul], at["say"], 5, 1) or bool(denied),
        "no_self": bool(harsh or at["violence"] or at["death"]) and _near(me, at["feel"], 0, 2) and not you or bool(of_self),
        "no_thing": bool(of_thing),
        "no_trade": len(at["thing"]) * 4 >= len(w) or sum(x.isdigit() for x in w) * 6 >= len(w),
    }
    mask = sum(1 << j for j, name in enumerate(VOTERS) if fires.get(name))
    return mask or 1 << (len(VOTERS) - 1)


def unpack(masks: np.ndarray) -> np.ndarray:
    """0/1 matrix of the votes of masks."""
    return ((masks[:, None] >> np.arange(len(VOTERS))[None, :]) & 1).astype(np.int8)


class LabelModel:
    """p(vote_j | vote_parent(j), class) on a tree over the voters and p(class), fitted by EM to weighted vote patterns; examples keep
    their class. A voter's rates are free, but it may not fire more often on the class it does not vote for."""

    def __init__(self, prior: float = 0.02, rounds: int = 40, smooth: float = 2.0):
        self.prior, self.rounds, self.smooth = prior, rounds, smooth
        self.parent = [-1] * len(VOTERS)

    def fit(self, patterns: np.ndarray, counts: np.ndarray, examples: np.ndarray, labels: np.ndarray, weight: float = 20.0) -> LabelModel:
        x = np.vstack([unpack(patterns), unpack(examples)]) if len(examples) else unpack(patterns)
        n = np.concatenate([counts.astype(float), np.full(len(examples), weight)])
        fixed = np.concatenate([np.full(len(patterns), np.nan), labels.astype(float)])
        # where no voter speaks of offence there is none to be estimated from
        fixed[: len(patterns)][patterns & LOUD == 0] = 0.0
        start = x @ np.where(HARMLESS, -2.5, 2.5) - 1.0
        q = np.where(np.isnan(fixed), 1 / (1 + np.exp(-start)), fixed)
        for step in (0, 1):
            for _ in range(self.rounds):
                self._estimate(x, n, q)
                q = np.where(np.isnan(fixed), self._posterior(x), fixed)
            if step == 0:
                self._dependences(x, n, q)
        self._estimate(x, n, q)
        return self

    def _estimate(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        w = np.stack([n * (1 - q), n * q])
        # the share of offensive sentences, drawn to the first guess as by a hundred sentences
        share = (w[1].sum() + 100 * self.prior) / (n.sum() + 100)
        self.class_log = np.log(np.array([1 - share, share]))
        #: table[j][class, value of the parent, own value]
        self.table = []
        for j, p in enumerate(self.parent):
            t = np.zeros((2, 2, 2))
            above = x[:, p] if p >= 0 else np.zeros(len(x), dtype=np.int8)
            for c in (0, 1):
                np.add.at(t[c], (above, x[:, j]), w[c])
            # with few rows a voter's rate is drawn to a guess of its sign
            rate = np.where(HARMLESS[j], np.array([0.05, 0.01]), np.array([0.001, 0.1]))
            for c in (0, 1):
                t[c] += self.smooth * np.array([1 - rate[c], rate[c]])
            rates = t[:, :, 1] / t.sum(axis=2)
            own, other = (0, 1) if HARMLESS[j] else (1, 0)
            rates[other] = np.minimum(rates[other], rates[own])
            self.table.append(np.log(np.stack([1 - rates, rates], axis=2)))

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.class_log, (len(x), 1))
        for j, p in enumerate(self.parent):
            above = x[:, p] if p >= 0 else np.zeros(len(x), dtype=np.int8)
            score += self.table[j][:, above, x[:, j]].T
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))

    def _dependences(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        """Spanning tree of the largest conditional mutual information between voters; weak links are left out."""
        v = len(VOTERS)
        info = np.zeros((v, v))
        total = n.sum()
        for w in (n * (1 - q), n * q):
            m = w.sum()
            if m < 20:
                continue
            one = (x * w[:, None]).sum(axis=0) / m
            both = (x * w[:, None]).T @ x / m
            for a in range(v):
                for b in range(a):
                    cells = [(both[a, b], one[a] * one[b]), (one[a] - both[a, b], one[a] * (1 - one[b])), (one[b] - both[a, b], one[b] * (1 - one[a])), (1 - one[a] - one[b] + both[a, b], (1 - one[a]) * (1 - one[b]))]
                    info[a, b] += m / total * sum(p * np.log(p / r) for p, r in cells if p > 1e-12 and r > 1e-12)
        info += info.T
        joined = {0}
        while len(joined) < v:
            a, b = max(((a, b) for a in joined for b in range(v) if b not in joined), key=lambda e: info[e])
            self.parent[b] = a if info[a, b] > 1e-4 else -1
            joined.add(b)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return np.where(masks & LOUD == 0, 0.0, self._posterior(unpack(masks))) if len(masks) else np.zeros(0)


def features(words: str, mask: int) -> np.ndarray:
    """Hashed words, word pairs and votes of a sentence."""
    w = [x if not x.isdigit() else "0" for x in words.split() if x != ","]
    named = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)), *(f"{a} * {c}" for a, c in zip(w, w[2:], strict=False))}
    ids = {zlib.crc32(f.encode()) % (BITS - 64) for f in named}
    ids |= {BITS - 64 + j for j in range(len(VOTERS)) if mask >> j & 1}
    return np.fromiter(sorted(ids), dtype=np.int64)


def train_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 2e-6, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps over shuffled mini-batches."""
    w, square, bias, bias_square = np.zeros(BITS), np.full(BITS, 1e-3), -2.0, 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            scale = 1 / np.sqrt(np.bincount(owner, minlength=len(part)) + 1e-9)
            z = np.bincount(owner, weights=w[ids] * scale[owner], minlength=len(part)) + bias
            gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[part]) * weight[part]
            used, where = np.unique(ids, return_inverse=True)
            g = np.bincount(where, weights=gap[owner] * scale[owner]) + decay * w[used] * len(part)
            square[used] += g * g
            w[used] -= rate * g / np.sqrt(square[used])
            bias_square += gap.sum() ** 2
            bias -= rate * 0.3 * gap.sum() / np.sqrt(bias_square)
    return w.astype(np.float32), float(bias)


class Scorer:
    """Score of a sentence in [0, 1]; a bounded number of sentences is remembered."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.score = lru_cache(maxsize=SENTENCES_KEPT)(self._score)

    def _score(self, sentence: str) -> float:
        words = plain(sentence)
        ids = features(words, votes(words))
        if not len(ids):
            return 0.0
        z = float(self.weights[ids].sum()) / np.sqrt(len(ids)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def document(self, text: str | None) -> float:
        return max((self.score(s) for s in sentences(text)), default=0.0)


def vote_patterns(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of all vote patterns (mask, n) over all sentences of all documents, and of each pattern the sentences of smallest hash (mask, h, s).

    Every task counts and keeps its own smallest ones; these are merged in two steps, so no task gets the samples of all others.
    """

    def most(mask: int) -> int:
        return PER_QUIET_PATTERN if mask & LOUD == 0 else PER_PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=SENTENCES_KEPT)(lambda s: votes(plain(s)))
        counts: dict[int, int] = {}
        kept: dict[int, dict[int, str]] = {}
        for pdf in batches:
            for value in pdf[text]:
                for s in sentences(value):
                    mask = cached(s)
                    counts[mask] = counts.get(mask, 0) + 1
                    own = kept.setdefault(mask, {})
                    own[zlib.crc32(s.encode("utf-8", "replace"))] = s
                    if len(own) > 2 * most(mask):
                        kept[mask] = {k: own[k] for k in sorted(own)[: most(mask)]}
        for mask, n in counts.items():
            smallest = sorted(kept[mask])[: most(mask)]
            yield pd.DataFrame({"mask": mask, "n": [n] + [0] * len(smallest), "h": [-1, *smallest], "s": [None, *(kept[mask][h] for h in smallest)]})

    parts = checkpoint(docs.select(F.col(f"`{text}`").alias(text)).mapInPandas(run, "mask long, n long, h long, s string"))
    limit = F.when(F.col("mask").bitwiseAND(LOUD) == 0, PER_QUIET_PATTERN).otherwise(PER_PATTERN)
    sample = parts.where("h >= 0").groupBy("mask", "h").agg(F.min("s").alias("s"))
    for keys in (["mask", F.pmod(F.col("h"), F.lit(64))], ["mask"]):
        sample = sample.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("_at") <= limit).drop("_at")
    return parts.groupBy("mask").agg(F.sum("n").alias("n")), sample


def train(docs: DataFrame, examples: DataFrame, text: str = "text") -> tuple[np.ndarray, float, LabelModel]:
    """Weights and bias of the linear classifier, and the label model.

    Pattern counts come from all documents. At most ``PER_PATTERN`` (harmless patterns: ``PER_QUIET_PATTERN``) sentences of each of the
    ``TAUGHT_PATTERNS`` most frequent patterns teach the classifier. More than ``MOST_PATTERNS`` patterns or ``MOST_EXAMPLES`` examples raise.
    """
    counted, sample = vote_patterns(docs, text)
    rows = sorted(((r["mask"], r["n"]) for r in counted.limit(MOST_PATTERNS + 1).collect()), key=lambda r: (-r[1], r[0]))
    shown = sorted((r.text, r.category) for r in examples.select("text", "category").where(F.col("text").isNotNull() & F.col("category").isNotNull()).limit(MOST_EXAMPLES + 1).collect())
    if len(rows) > MOST_PATTERNS or len(shown) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_PATTERNS} vote patterns or {MOST_EXAMPLES} examples")
    taught = docs.sparkSession.createDataFrame([(m,) for m, _ in rows[:TAUGHT_PATTERNS]], "mask long")
    kept = sorted((r["mask"], r["h"], r["s"]) for r in sample.join(F.broadcast(taught), "mask", "left_semi").collect())
    example_words = [plain(t) for t, _ in shown]
    example_masks = np.array([votes(w) for w in example_words], dtype=np.int64)
    example_labels = np.array([float(c != "none") for _, c in shown])
    masks = np.array([m for m, _ in rows], dtype=np.int64)
    model = LabelModel().fit(masks, np.array([n for _, n in rows], dtype=float), example_masks, example_labels)
    posterior = dict(zip(masks.tolist(), model.posterior(masks).tolist(), strict=True))
    data = [(features(w, int(m)), y, 4.0) for w, m, y in zip(example_words, example_masks, example_labels, strict=True)]
    data += [(features(plain(s), m), posterior[m], 1.0) for m, _, s in kept]
    data = [d for d in data if len(d[0])]
    if not data:
        return np.zeros(BITS, dtype=np.float32), -2.0, model
    weights, bias = train_linear([d[0] for d in data], np.array([d[1] for d in data]), np.array([d[2] for d in data]))
    return weights, bias, model


_scorers: dict[tuple[int, float], Scorer] = {}


def score_documents(docs: DataFrame, examples: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, and ``score double`` in [0, 1] (0 for an empty or null text) and ``flagged boolean`` (score at least ``THRESHOLD``).

    Clashing columns are replaced; repeated rows stay; an empty table gives an empty result.
    """
    weights, bias, _ = train(docs, examples, text)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    key = zlib.crc32(weights.tobytes()), bias

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*shared.value)
        return texts.map(_scorers[key].document, na_action=None).astype(float)

    scored = docs.withColumn("score", score(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return scored.withColumn("flagged", F.col("score") >= THRESHOLD)


def rates_per_source(scored: DataFrame) -> DataFrame:
    """Per source (null as its own group): documents, flagged documents, their rate and the mean score."""
    agg = scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg("score").alias("mean_score"))
    return agg.withColumn("rate", F.col("flagged") / F.col("documents"))
