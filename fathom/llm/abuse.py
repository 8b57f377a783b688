"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes what hides a word: broken encoding, compatibility forms, accents, invisible characters, look-alike letters of
other alphabets, digits and signs for letters (``5h17``), letters set apart (``b.a.d``), drawn out (``baaad``), masked with
asterisks (``b*d``), and, for insults, one letter lost or two swapped. Folded words form one string per document on which a single
automaton finds all lexicon phrases in one pass.

Each phrase has a category and a weight. Words that may also be said of things or of oneself weigh less than 1 and
count in full only together with others near by: an insult with a second person beside it, violence with somebody who announces it, a
hostile predicate with a group. Exception phrases weigh against them: things, oneself, medicine, and reports about moderation. The score of a
sentence is the greatest sum within ``WINDOW`` words; a sentence with at least ``THRESHOLD`` is abusive. A document's score is the sum over its
abusive sentences per 100 words.

The lexicon has two parts. The general one is written by hand for four languages and knows no particular data. ``fit`` adds phrases learned from
judged documents: runs of 3 and 4 words that stand in several documents which all raters called abusive and in next to none that all called
harmless; the fewest that explain the judgements are taken, with the other runs of the same sentences. It reads at most ``JUDGED`` judged documents, those
of the least hashes, and without judgements the general part works alone.

Defined cases: null, empty and blank texts score 0 and are not abusive. Repeated rows are scored each. Whole texts are read. Judgements
that differ teach nothing; neither do judged documents that are missing or null. The lexicon is of bounded size and shipped with the tasks; nothing
else is broadcast and scoring needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import checkpoint

THRESHOLD = 1.0
WINDOW = 30
NEAR = 4
#: The most that mild hostile predicates count without a group.
MILD = 0.9
#: What fit() takes: judged documents at most, words of a phrase, documents that must hold it, and how many of those must be abusive.
JUDGED, PHRASE, SUPPORT, PRECISION = 20_000, (3, 4), 3, 0.9
#: Tokens whose folded form a process remembers.
REMEMBERED = 500_000

#: Words that name a person with contempt; they count in full when said to or of somebody.
INSULTS = """idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits nitwit nitwits dumbass dumbasses asshole assholes arsehole arseholes
jackass jackasses bastard bastards bitch bitches loser losers clown clowns pig pigs swine parasite scumbag scumbags dirtbag scum maggot maggots dipshit shithead shitheads fuckwit fuckhead dickhead dickheads
prick pricks twat twats wanker wankers tosser pillock plonker prat bellend retard retards fool fools buffoon dolt dunce numbskull blockhead bonehead airhead simpleton dullard weirdo creep freak lowlife deadbeat coward
hypocrite fraud pervert worm cow sleazebag slob hag skank degenerate douche douchebag cuck incel dumbfuck shitbag garbage trash vermin filth cockroach disgrace
arschloch vollidiot idioten schwachkopf versager trottel dummkopf spast vollpfosten hohlkopf penner mistkerl mistkerle drecksau dreckstuck mistvieh abschaum blodmann idiotin depp
idiota idiotas payaso payasa cabron cabrones pendejo pendeja imbecil inutil estupido estupida tarado mamon capullo baboso escoria malnacido subnormal
batard abruti abrutie cretine debile bouffon ordure raclure minable salaud salopard pourriture crevure andouille
piece of shit|piece of trash|piece of garbage|piece of crap|piece of filth|sack of shit|waste of skin|waste of oxygen|waste of space|waste of air|waste of a human|pedazo de mierda|tas de merde|stuck scheisse|stuck dreck"""
#: Words so abusive that they need no other sign.
SLURS = """motherfucker motherfuckers cocksucker cunt cunts whore whores slut sluts faggot faggots nigger niggers kike kikes spic spics chink chinks wetback wetbacks raghead towelhead tranny trannies hurensohn wichser schlampe fotze missgeburt kanake
gilipollas maricon maricones puto sudaca connard connasse salope encule pute bougnoule"""
ADJECTIVES = """worthless pathetic disgusting filthy useless brainless spineless miserable braindead fucking stupid dumb ugly dumbest stupidest ugliest fat repulsive vile revolting moronic idiotic incompetent retarded clueless gutless rotten sick lazy
nutzloses dummer dumme erbarmlicher widerlicher ekelhafter asqueroso asquerosa debil patetico patetica pathetique degoutant degoutante stupide"""
SEXUAL = {"pussy": 0.8, "tits": 0.8, "boobs": 0.6, "horny": 0.8, "dick": 0.5, "cock": 0.4, "nudes": 0.6, "naked": 0.3, "nude": 0.3, "blowjob": 1.0, "handjob": 1.0, "cumshot": 1.0, "rimjob": 1.0, "moaned": 0.5, "orgasm": 0.6, "orgasms": 0.6, "porn": 0.6, "sex": 0.3, "sexy": 0.3, "erection": 0.5, "clit": 1.0, "dildo": 0.8, "ficken": 1.0, "titten": 1.0, "muschi": 1.0, "nacktbilder": 0.8, "follarte": 1.0, "follar": 0.8, "tetas": 1.0, "desnuda": 0.4, "desnudo": 0.3, "thighs": 0.4, "polla": 0.7, "bite": 0.2, "chatte": 0.6, "nichons": 1.0, "seins": 0.5}
#: Groups of people; they count together with something hostile said of them.
GROUPS = """immigrants|migrants|foreigners|refugees|asylum seekers|jews|muslims|christians|hindus|arabs|africans|mexicans|asians|chinese|indians|turks|poles|gypsies|roma|gays|lesbians|homosexuals|queers|transgenders|trans people|trans women|
blacks|black people|white people|women|girls|old folks|old people|the elderly|disabled people|the disabled|cripples|poor people|homeless people|beggars|believers|atheists|worshippers|those people|these people|your people|that kind|their kind|your kind|people like them|
auslander|fluchtlinge|migranten|juden|moslems|muslime|turken|schwule|frauen|behinderte|zigeuner|diese leute|extranjeros|inmigrantes|refugiados|judios|musulmanes|gitanos|moros|negros|mujeres|esa gente|etrangers|immigres|refugies|juifs|musulmans|arabes|noirs|femmes|ces gens"""
YOU = "you your youre yourself u ur du dich dein deine dir tu te ti eres ton ta toi vous".split()

#: What people threaten to do to a person, and to whom or what of theirs.
VIOLENCE = "kill hurt beat stab shoot strangle choke punch slap burn bury skin drown rape murder cripple".split()
BODY = "face neck legs arms bones skull head throat teeth nose jaw fingers knees hands family house home car wife husband kids children mother daughter parents".split()
BREAK = "break smash crush cut slit burn punch kick hurt kill".split()
#: Who announces or demands it.
INTENT = "i will|ill|i am going to|im going to|i am gonna|im gonna|gonna|i want to|i would love to|we will|we are going to|someone should|somebody should|someone ought to|they should|people should"
FATES = "die|rot|choke|burn|suffer|drown|bleed|get cancer|get hit by|never wake up|end up dead|lose everything"
INJURIES = "die|rot|suffer|burn|hang|be shot|be beaten|be hanged|be raped|be killed|be put down|get beaten|get hurt|drop dead"

# weight 1: such a sentence needs no other sign; below: only together with another sign near by
ABUSIVE = """1 kill yourself|kill your self|kys|hang yourself|shoot yourself|neck yourself|drown yourself|end your life|slit your wrists|drink bleach|drop dead|go die|jump off a bridge|jump off a roof|jump out of a window|jump in front of a|
nobody would miss you|no one would miss you|nobody will miss you|nobody will ever love you|no one will ever love you|everyone hates you|everybody hates you|we all hate you|nobody likes you|no one likes you|nobody loves you|better off without you|better off dead|
world would be better without you|should never have been born|should have been aborted|shut your mouth|shut your face|shut the fuck up|fuck you|fuck off|go fuck yourself|eat shit|suck a dick|go to hell|rot in hell|burn in hell|i hate you so|
i know where you live|find out where you live|we know where you live|watch your back|sleep with one eye open|coming for you and your|wont see another|wont live to see|will regret being born|put a bullet in|skin you alive|beat you up|
beat the shit out of you|knock your teeth|spit in your face|spit on you|piss on your grave|dance on your grave|you make us sick|you make me sick|you make me want to vomit|you disgust me|you disgust us|your mother is a|your mom is a|your mother should have|son of a bitch|
dumb as you|stupid as you|as dumb as you|as stupid as you|dumber than you|you are nothing but|you are subhuman|you are vermin|ashamed of you|embarrassment to your family|disgrace to your family|crawl back into|
halt die fresse|halt die schnauze|halt dein maul|halts maul|fick dich|verpiss dich|verreck doch|verrecke|verreck|bring dich um|bringe dich um|mach dich fertig|mache dich fertig|schlag dich|schlage dich|schlag dir|schlage dir|brech dir|breche dir|stech dich ab|steche dich ab|
geh sterben|hang dich auf|spring vom dach|ich finde dich|weiss wo du wohnst|deine mutter ist|leck mich am arsch|niemand mag dich|keiner mag dich|du bist abschaum|du bist dreck|
callate de una puta vez|hijo de puta|hija de puta|muerete|ojala te mueras|ojala te pudras|te voy a matar|te voy a romper|te voy a partir|te voy a reventar|te voy a encontrar|voy a romperte|voy a partirte|vete a la mierda|vete al infierno|que te den|te mataria|se donde vives|
romper la cara|partir la cara|me das asco|nos das asco|pudrete|matate|nadie te quiere|eres una mierda|eres basura|eres una basura|
va crever|creve donc|tu vas crever|pauvre con|pauvre conne|pauvre imbecile|casser les dents|casser la gueule|casser la figure|ferme ta gueule|ta gueule|nique ta mere|fils de pute|va te faire|va te pendre|je vais te tuer|je vais te crever|je vais te casser|je vais te frapper|
je vais te trouver|je te tuerai|je sais ou tu habites|tu me degoutes|tu nous degoutes|sale con|sale conne|sale chien|sale porc|personne ne t aime|personne ne taime|tue toi|pends toi|tu es une merde
0.7 i will find you|ill find you|too stupid to|too dumb to|too lazy to|brain damage|brain of a|iq of a|the average iq|stfu|piss off|screw you|hunt you|regret the day|your ugly|your stupid|your pathetic|your worthless|your filthy|your disgusting|your miserable|you smell|you stink|you people are|people like you|
someone like you|somebody like you|bastards like you|nobody wants you|nobody needs you|nobody asked you|shut up|go back to school|learn to read|ashamed of yourself|makes me sick|
deine mutter|so ein|wie du gehort|du gehorst|du bist so|du bist ein|dich braucht keiner|idioten wie|leute wie du|typen wie du|tu madre|eres un|eres una|eres mas tonto|gente como tu|eres lo peor|tu es un|tu es une|tu n es qu|tu nes qu|t es qu|des gens comme toi|espece de|degueulasse
0.5 you deserve|should be fired|should be beaten|every time you open your mouth|nobody in their right mind|in your whole life|beaten|verprugelt|pauvre|crever|sterben|morir"""
HATEFUL = """1 are subhuman|are subhumans|are untermenschen|are not real people|are not people|are not human|are not humans|not fully human|not even human|are no humans|inferior race|should not be allowed to breed|should not be allowed to vote|should not have children|breed like|multiply like rats|
belong in cages|belong in a cage|belong in camps|belong in a camp|belong in a zoo|belong in the gutter|go back where you came from|go back to where you came from|go back to your country|go back to africa|ship them back|hang them all|shoot them all|kill them all|drown them all|
gas them|exterminate them|wipe them out|burn their houses|infest our|infesting our|ruin our country|ruining our country|invade our country|
sind ungeziefer|sind abschaum|sind untermenschen|sind keine menschen|sind keine echten menschen|auslander raus|gehoren vergast|gehoren in kafige|gehoren abgeschoben|vermehren sich wie|sollte man vergasen|alle abschieben|
son escoria|son alimanas|no son personas|no son gente|no son humanos|hay que echarlos|habria que echarlos|habria que matarlos|fuera los|vuelvan a su pais|se reproducen como|deberian estar en jaulas|
sont de la vermine|sont des cafards|sont des sous hommes|ne sont pas des humains|ne sont pas des gens|faut tous les virer|faut tous les bruler|faut tous les enfermer|rentrez chez vous|retournez chez vous|retourne dans ton pays|se reproduisent comme|devraient etre en cage
0.6 are vermin|are rats|are parasites|are scum|are animals|are trash|are garbage|are filth|are savages|are cockroaches|are criminals|are thieves|are rapists|are terrorists|are liars|are lazy|are stupid|are dirty|are disgusting|are inferior|are dumb|are a plague|are a disease|are a cancer|are monkeys|are apes|are pigs|are dogs|
are leeches|are invaders|are degenerates|are perverts|are freaks|are less intelligent|are all the same|are nothing but|are all|should be wiped out|cannot think|cannot be trusted|cannot count|a plague|should be deported|should all be|should be shot|should be hanged|should be sterilised|should be sterilized|should be locked up|should be banned|should be thrown out|
should be kicked out|should be burned|should be gassed|should stay in the kitchen|belong in the kitchen|belong in prison|belong behind bars|belong in|do not belong|dont belong|not welcome|should not vote|should not be allowed|must not be allowed|get rid of|got rid of|throw them out|kick them out|lock them up|round them up|
round up the|send them back|keep them away|away from our|out of our country|never hire|do not hire|dont hire|never trust|never work with|steal our|steal what|are stealing|they smell|they stink|they lie|too dumb to|too lazy to|always cheat|only know how to|
sind tiere|sind ratten|sind parasiten|sind dreck|sind eine plage|sind faul|sind dumm|sind kriminelle|gehoren rausgeworfen|gehoren eingesperrt|stinken|rauswerfen|abschieben|einsperren|nicht einstellen|stellt keine|nehmen uns|sind alle|sind nichts als|
son basura|son animales|son parasitos|son ratas|son unas ratas|son una plaga|son bestias|son ladrones|son vagos|echarlos|no contraten|nos roban|apestan|son todos|no son mas que|
sont des parasites|sont des rats|sont des animaux|sont des betes|sont des dechets|sont des ordures|sont des voleurs|sont une plaie|sont une maladie|les virer|n embauchez pas|nembauchez pas|nous volent|puent|dehors|sales|sont tous|ne sont que
0.4 filthy|typical for|typical of|typisch fur|tipico de|typique des|all of them|no more|never again"""
EXPLICIT = """1 want to fuck|wanna fuck|to fuck you|fuck you on|fucked her|fucked him|fucks her|fucks him|fuck her|fuck him|send me nudes|send nudes|nude pics|naked pics|nude photos|naked photos|dick pic|dick pics|spreading her legs|spreading his legs|spread your legs|spread her legs|came all over|cum all over|suck my dick|
suck my cock|suck my pussy|touch myself|pushed his cock|rough sex|anal sex|oral sex with|cum on my|cum in my|sit on my face|jerk off|jerking off|thrust into|thrusting into|bend you over|bent you over|bent her over|ride you until|ride me until|make you cum|make you moan|scream my name|made her cum|make me cum|
stroked him|stroking his|stroking her|deep inside her|deep inside you|gangbang|creampie|his cock|her cock|my cock|your cock|hard cock|his dick|my dick|your dick|wet pussy|your nipples|her nipples|unzipped his|lick your|lick you|lick her|get naked for|naked for me|sex with you|sex with me|sleep with me tonight|
te baiser|te sucer|me sucer|suce moi|baise moi|photos de toi nue|photo de toi nue|montre moi tes seins|tes seins|ton cul|ta chatte|te lecher|deshabille toi|
ich will dich ficken|dich ficken|fick mich|schick mir nacktbilder|nacktbilder|so geil auf|lutsch meinen|blas mir|deine titten|deine bruste|zieh dich aus|meinen schwanz|seinen schwanz|deine muschi|
quiero follar|quiero follarte|follame|tus tetas|tu culo|tu cono|chupame|chuparte|mi polla|te quiero desnuda|verte desnuda|verte desnudo|fotos desnuda|fotos desnudo|desnudate|estoy mojada|te la meto|correrme
0.8 suck my|so wet|wet mouth|naked body|bare ass|hot sex|hard dick|your tits|lick his|lick my|fuck me|until she came|until he came|turns me on|turn me on|hard for you|wet for you|panties|nipples|your breasts|her breasts|your ass|her ass|your thighs|her thighs|between her legs|between his legs|between your legs|
masturbate|masturbated|masturbating|masturbation|threesome|milf|take off your clothes|undress for|slid into his|slid into her|he groaned|she groaned|in bed with you|what you wear in bed|dans mon lit|dans ton lit|im bett|en cama conmigo|zeig mir deine|mandame fotos|envoie moi des photos|montre tes
0.5 begged him|begged her|both naked|all night|toda la noche|die ganze nacht|toute la nuit|groaned|moaning|his trousers|her dress|her skirt|her bra|his pants|lingerie|stroked|envie de|caricias|gemia|gemir|stohnte|nackt|nue|schenkel"""
# what such words mean elsewhere: of things, of oneself, in medicine, in reports about moderation
EXCEPTIONS = """-2 breast cancer|sexual health|sexual abuse|sexual harassment|sex education|hate speech|abusive language|offensive language|profanity filter|word filter|word list|blocklist|code of conduct|community guidelines|our policy|our guidelines|content policy|moderation log|moderation queue|
moderation policy|moderation report|abuse report|toxicity classifier|report abusive|flagged as|classified as|labelled as|labeled as|as abusive|as toxic|as offensive|as hateful|as harassment|examples of insults|example of an insult|the word|the slur|the phrase|yourself in the foot|idiot proof|idiot s guide
-0.8 i am an idiot|i m an idiot|im an idiot|i am such|im such|i was an idiot|i was such|like an idiot|like a moron|like a fool|i feel stupid|i am stupid|im stupid|stupid me|my stupid|silly me|call me|calling me|call myself|calling myself|kill the process|kill the job|kill it|garbage collector|garbage collection|guinea pig|guinea pigs|
pig latin|apache pig|clown fish|stupid question|dumb question|stupid mistake|stupid bug|dumb terminal|naked pointer|moby dick|on garbage"""
#: Reports about moderation: somebody in charge did something with a message, or a message or its author had it done.
MODERATORS = "moderator|moderators|mods|admin|admins|the team|we"
MODERATED = "removed|deleted|flagged|banned|suspended|warned|reported|hid|blocked|reviewed|muted|locked|escalated"
PASSIVE = "was|were|been|got|is|being|gets"

#: Look-alike letters and their Latin forms, signs and digits and their letters: fixed values.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁкмтвнгпαοειντυκρχωı", "aeopcyxisjhdkmtbhrnaoeivtukpxwi")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t"}
#: Ordinary words that one lost or swapped letter would make of an insult.
ORDINARY = set("moon lose itch horn wore rash lower close puss rat rats clone cow cows fol foo fools foot ool pi big pigs in put out oser idols clow own down lost horny nude nudes tramp cretin parasites trotte cuts cut carbon spat past anker dumme poll teas hors idol hones mores count counts shut duck luck".split())

_MOJIBAKE = re.compile(r"[ÂÃâ][\u0080-ÿŒ-ƒˆ-™]{1,2}")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
#: Patterns over case-folded text, for letters of any alphabet and, faster, for those of ASCII.
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]|[013457@$!])(?:[ ._\-*·]{1,2}(?:[^\W\d_]|[013457@$!])){2,}(?![^\W_])")
_APART_ASCII = re.compile(r"(?<![a-z0-9])[a-z013457@$!](?:[ ._\-*]{1,2}[a-z013457@$!]){2,}(?![a-z0-9])")
_TOKEN = re.compile(r"[^\W_]++(?:['’][^\W_]++)?+(?![*@$!€])|[^\W_]*[*@$!€][\w*@$!€]*[\w*]|[^\W_]+(?:['’][^\W_]+)?|[.!?…]+(?=[\s\"'”)*]|$)|\n[ \t]*\n")
_TOKEN_ASCII = re.compile(r"[a-z0-9]++(?:'[a-z0-9]++)?+(?![*@$!])|[a-z0-9]*[*@$!][a-z0-9_*@$!]*[a-z0-9_*]|[a-z0-9]+(?:'[a-z0-9]+)?|[.!?]+(?=[\s\"')*]|$)|\n[ \t]*\n")
_DRAWN = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")


def _mended(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return m.group()


def _listed(block: str) -> list[str]:
    """The entries of a list: phrases between bars, or words."""
    return [p.strip() for line in block.splitlines() for p in (line.split("|") if "|" in line else line.split()) if p.strip()]


def _weighted(block: str) -> Iterator[tuple[str, float]]:
    weight = 0.0
    for line in block.splitlines():
        head, _, rest = line.partition(" ")
        try:
            weight, line = float(head), rest
        except ValueError:
            pass
        yield from ((p.strip(), weight) for p in line.split("|") if p.strip())


def _made() -> Iterator[tuple[str, str, float]]:
    """Phrases made by rule: (phrase, category, weight)."""
    weak = {"fucking", "sick", "lazy", "rotten", "clueless", "incompetent", "fat"}
    for w in _listed(ADJECTIVES):
        if w not in weak:
            for start in ("you are", "youre", "you are so", "youre so", "you are such a", "you are the", "du bist", "eres", "tu es"):
                yield f"{start} {w}", "abusive", 1.0
    for v in VIOLENCE:
        yield f"{v} you", "threat", 0.7
        for w in ("him", "her", "them"):
            yield f"{v} {w}", "threat", 0.6
    for v, w in product(BREAK, BODY):
        yield f"{v} your {w}", "threat", 0.7
    for p in INTENT.split("|"):
        yield p, "intent", 0.4
    for p, w in product(FATES.split("|"), ("hope you", "hope you all", "hope they", "wish you would", "wish you")):
        yield f"{w} {p}", "abusive", 1.0
    for p in INJURIES.split("|"):
        yield f"you deserve to {p}", "abusive", 1.0
        yield f"they deserve to {p}", "hateful", 1.0
        yield f"deserve to {p}", "abusive", 0.6
    for m, v in product(MODERATORS.split("|"), MODERATED.split("|")):
        yield f"{m} {v}", "exception", -2.0
    for m, v in product(PASSIVE.split("|"), MODERATED.split("|")):
        yield f"{m} {v}", "exception", -1.2


class Lexicon:
    """Phrases with category and weight, their automaton, and the variants of their words. ``learned`` are (phrase, category) of fit()."""

    def __init__(self, learned: Iterable[tuple[str, str]] = ()) -> None:
        import ahocorasick

        self.phrases: dict[str, tuple[str, float]] = {}
        add = lambda p, c, w: self.phrases.setdefault(p, (c, w))
        for p, c in learned:
            add(p, c, 1.0)
        insults, slurs, adjectives = _listed(INSULTS), _listed(SLURS), _listed(ADJECTIVES)
        for block, category in ((ABUSIVE, "abusive"), (HATEFUL, "hateful"), (EXPLICIT, "sexual"), (EXCEPTIONS, "exception")):
            for p, w in _weighted(block):
                add(p, category, w)
        for p, c, w in _made():
            add(p, c, w)
        for w in insults:
            add(w, "insult", 0.6)
        for w in slurs:
            add(w, "abusive", 1.0)
        for w in adjectives:
            add(w, "adjective", 0.4)
        for w, x in SEXUAL.items():
            add(w, "sexual", x)
        for g in GROUPS.replace("\n", "").split("|"):
            add(g, "group", 0.5)
        for w in YOU:
            add(w, "you", 0.0)
        self.automaton = ahocorasick.Automaton()
        for p, (c, w) in self.phrases.items():
            self.automaton.add_word(f" {p} ", (c, w, p.count(" ") + 1))
        self.automaton.make_automaton()
        self.words = {w for p in self.phrases for w in p.split()}
        self.longest = max(map(len, self.words))
        self.by_length = defaultdict(list)
        strong = [w for w in dict.fromkeys([*insults, *slurs, *adjectives, *SEXUAL, "shit", "fuck"]) if len(w) > 2 and " " not in w]
        for w in strong:
            self.by_length[len(w)].append(w)
        self.collapsed = {}
        for w in sorted(self.words):
            if len(w) >= 4 and (c := _DOUBLE.sub(r"\1", w)) not in self.words:
                self.collapsed.setdefault(c, w)
        self.slips = {}
        for w in strong:
            if len(w) < 5:
                continue
            lost = {w[:i] + w[i + 1 :] for i in range(len(w))}
            swapped = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
            for v in lost | swapped:
                if v not in self.words and v not in ORDINARY and len(v) >= 4:
                    self.slips.setdefault(v, w)
        self.folded = _Folded(self)

    def canonical(self, token: str) -> str:
        """The lexicon's word for a token, or the token."""
        if token in self.words:
            return token
        if "*" in token:
            inner = token.strip("*")
            if "*" not in inner and len(inner) > 2 and (token[0] == token[-1] == "*"):
                return self.canonical(inner)
            if sum(c.isalpha() for c in token) >= 2:
                fits = [w for w in self.by_length[len(token)] if all(a in ("*", b) for a, b in zip(token, w, strict=True))]
                if fits:
                    return fits[0]
            return self.canonical(inner) if inner and inner != token else token
        if not token.isalpha() and any(c.isalpha() for c in token):
            for one in ("i", "l"):
                plain = "".join(one if c == "1" else LEET.get(c, c) for c in token)
                if plain.isalpha() and plain != token and (found := self._plain(plain)) in self.words:
                    return found
            return token
        return self._plain(token)

    def _plain(self, token: str) -> str:
        if token in self.words:
            return token
        drawn = _DRAWN.sub(r"\1", token)
        if drawn != token:
            if drawn in self.words:
                return drawn
            if (short := _DOUBLE.sub(r"\1", token)) in self.collapsed:
                return self.collapsed[short]
            if short in self.words and len(short) >= 3:
                return short
        if token in self.slips:
            return self.slips[token]
        double = _DOUBLE.sub(r"\1", token)
        return double if double != token and double in self.words and len(double) >= 5 and token not in ORDINARY else token

    def fold(self, text: str) -> list[str]:
        """Folded words and sentence ends (as ".")."""
        if not text.isascii():
            if "Ã" in text or "â" in text or "Â" in text:
                text = _MOJIBAKE.sub(_mended, text)
            text = _INVISIBLE.sub("", _MARKS.sub("", unicodedata.normalize("NFKD", text)))
        text = text.casefold()
        if not text.isascii():
            text = text.translate(LOOKALIKES)
        apart, token = (_APART_ASCII, _TOKEN_ASCII) if text.isascii() else (_APART, _TOKEN)
        return [self.folded[t] for t in token.findall(apart.sub(self._joined, text))]

    def _joined(self, m: re.Match) -> str:
        """Letters set apart, put together where they spell a lexicon word; a long row of letters is read once."""
        letters, out, at = re.findall(r"[^\W_]|[@$!]", m.group()), [], 0
        while at < len(letters):
            for size in range(min(self.longest, len(letters) - at), 2, -1):
                word = self.canonical("".join(letters[at : at + size]))
                if word in self.words:
                    out.append(word)
                    at += size
                    break
            else:
                out.append(letters[at])
                at += 1
        return " ".join(out) if any(len(w) > 1 for w in out) else m.group()

    def sentences(self, text: str | None) -> tuple[int, list[tuple[float, str]]]:
        """How many words a text has, and (score, category) of its sentences that hold something of the lexicon."""
        if not text:
            return 0, []
        words = self.fold(text)
        line = f" {' '.join(words)} "
        found = [(end, *hit) for end, hit in self.automaton.iter(line) if hit[0] != "you"]
        if not found:
            return len(words) - words.count("."), []
        stops = [i for i, w in enumerate(words) if w == "."]
        # sentences in letters and in words
        cuts, at = [], 1
        for i, w in enumerate(words):
            if w == ".":
                cuts.append(at)
            at += len(w) + 1
        out, last = [], -1
        for end, *_ in found:
            k = bisect_right(cuts, end - 1)
            if k != last:
                last = k
                a, b = (stops[k - 1] + 1 if k else 0), (stops[k] if k < len(stops) else len(words))
                out.append(self._score(words[a:b]))
        return len(words) - len(stops), out

    def _score(self, sentence: list[str]) -> tuple[float, str]:
        line = f" {' '.join(sentence)} "
        hits, you, starts, at = [], [], [], 1
        for w in sentence:
            starts.append(at)
            at += len(w) + 1
        for end, (category, weight, size) in self.automaton.iter(line):
            last = bisect_right(starts, end - 1) - 1
            if category == "you":
                you.append(last)
            else:
                hits.append((last - size + 1, last, category, weight))
        hits.sort()
        scored, group = [], any(h[2] == "group" for h in hits)
        for a, b, category, weight in hits:
            if category in ("insult", "adjective") and any(a - NEAR <= y <= b + NEAR for y in you):
                weight += 0.4 if category == "insult" else 0.3
            scored.append((a, category, weight))
        best, kind = 0.0, "none"
        for i, (a, _, _) in enumerate(scored):
            # what is added up: of insults, adjectives, groups, threats and their announcements the strongest, as repeated mild words say no more
            most, sums = defaultdict(float), defaultdict(float)
            for b, category, weight in scored[i:]:
                if b - a > WINDOW:
                    break
                if category in ("insult", "adjective", "group", "threat", "intent"):
                    most[category] = max(most[category], weight)
                elif category != "exception":
                    sums["mild" if category == "hateful" and weight < 1 else category] += weight
            mild = sums["mild"] if group else min(sums["mild"], MILD)  # said of things as well, unless a group is named
            person = sums["abusive"] + most["insult"] + most["adjective"] + most["threat"] + (most["intent"] if most["threat"] else 0.0)
            hate = sums["hateful"] + mild + (most["group"] if person or mild or sums["hateful"] else 0.0)
            total = max(person + hate, sums["sexual"]) + sum(w for b, c, w in scored if c == "exception" and abs(b - a) <= WINDOW)
            if total > best:
                best = total
                kind = "sexual" if sums["sexual"] >= person + hate else "hateful" if hate > person else "abusive"
        return round(best, 6), kind


class _Folded(dict):
    """Folded forms of tokens, remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> str:
        if token[0] in ".!?…\n" and not any(c.isalnum() for c in token):
            word = "."
        else:
            word = token.replace("'", "").replace("’", "")
            if len(word) > self.lexicon.longest:
                word = _DRAWN.sub(r"\1", word)
            word = self.lexicon.canonical(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = word
        return word


_LEXICA: dict[tuple, Lexicon] = {}


def lexicon(learned: tuple[tuple[str, str], ...] = ()) -> Lexicon:
    """The lexicon of this process, built once."""
    if learned not in _LEXICA:
        _LEXICA.clear()
        _LEXICA[learned] = Lexicon(learned)
    return _LEXICA[learned]


def score_text(text: str | None, by: Lexicon | None = None) -> tuple[float, float, int, str]:
    """(score per 100 words, worst sentence, abusive sentences, category of the worst); by the general lexicon unless another is given."""
    words, sentences = (by or lexicon()).sentences(text)
    bad = [s for s in sentences if s[0] >= THRESHOLD]
    worst = max((s[0] for s in sentences), default=0.0)
    return (100 * sum(s for s, _ in bad) / words if words else 0.0), worst, len(bad), max(bad)[1] if bad else "none"


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",), learned: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, *keep, score, worst, abusive_sentences, category) of every document; ``learned`` are phrases of fit()."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (doc_id, *keep)) + ", score double, worst double, abusive_sentences int, category string"
    learned = tuple(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = lexicon(learned)
        for b in batches:
            rows = [score_text(t, by) for t in b["text__"]]
            out = b.drop(columns="text__")
            out[["score", "worst", "abusive_sentences", "category"]] = pd.DataFrame(rows, columns=["score", "worst", "abusive_sentences", "category"], index=b.index)
            yield out

    return documents.select(*[F.col(f"`{c}`") for c in (doc_id, *keep)], F.col(f"`{text}`").alias("text__")).mapInPandas(run, schema)


# --- learning


def _phrases(text: str, sizes: tuple[int, ...]) -> Iterator[tuple[int, str]]:
    """(sentence, phrase) of all runs of ``sizes`` words within sentences."""
    sentence, k = [], 0
    for w in [*lexicon().fold(text), "."]:
        if w != ".":
            sentence.append(w)
            continue
        for n in sizes:
            yield from ((k, " ".join(sentence[i : i + n])) for i in range(len(sentence) - n + 1))
        sentence, k = [], k + 1


def cover(found: dict[str, set[tuple]], support: int = SUPPORT) -> list[str]:
    """The fewest phrases (greedily) that explain the documents, and the other phrases of the sentences they stand in. ``found`` has for each
    phrase the (document, sentence) places; its documents are what it explains."""
    documents = {p: {d for d, _ in places} for p, places in found.items()}
    left, chosen, sentences = set().union(*documents.values()) if documents else set(), [], set()
    gain = dict.fromkeys(documents, 0) | {p: len(d) for p, d in documents.items()}
    while left:
        # gains only fall, so the first phrase whose old gain is right is the best
        best = max(gain, key=lambda p: (gain[p], len(p), p), default=None)
        if best is None or gain[best] < support:
            break
        now = len(documents[best] & left)
        if now < gain[best]:
            gain[best] = now
            continue
        chosen.append(best)
        sentences |= found[best]
        left -= documents[best]
        del gain[best]
    beside = [p for p, places in found.items() if len(places & sentences) >= 0.8 * len(places)]
    return sorted({*chosen, *beside})


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", category: str = "category", judged: int = JUDGED, sizes: tuple[int, ...] = PHRASE, support: int = SUPPORT, precision: float = PRECISION) -> tuple[tuple[str, str], ...]:
    """(phrase, category) learned from judged documents, at most ``judged`` of them. What comes to the driver follows that bound."""
    votes = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("d")).agg(F.min(toxic).alias("low"), F.max(toxic).alias("high"), F.max(F.when(F.col(toxic) > 0, F.col(category))).alias("c"))
    agreed = votes.where("low = high").select("d", (F.col("low") > 0).alias("bad"), F.coalesce("c", F.lit("abusive")).alias("c")).orderBy(F.xxhash64("d"), "d").limit(judged)
    texts = documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).join(F.broadcast(agreed), "d")
    texts = checkpoint(texts)  # used three times; the documents are read once for it

    def counted(batches: Iterator[pd.DataFrame], among=None) -> Iterator[pd.DataFrame]:
        """The different phrases of each document, or those of them looked for."""
        for b in batches:
            held = ({p for _, p in _phrases(t, sizes)} for t in b["t"])
            yield pd.DataFrame({"p": [p for h in held for p in (h if among is None else h & among.value)]})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(p, d, k, c) for d, t, c in zip(b["d"], b["t"], b["c"], strict=True) for k, p in _phrases(t, sizes) if p in shared.value}
            yield pd.DataFrame(list(rows), columns=["p", "d", "k", "c"])

    spark, kind = documents.sparkSession, dict(documents.dtypes)[doc_id]
    bad = texts.where("bad").dropDuplicates(["d"])
    many = bad.mapInPandas(counted, "p string").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    often = {r.p: r.n for r in many.collect()}
    if not often:
        return ()
    looked = spark.sparkContext.broadcast(frozenset(often))
    harmless = texts.where("not bad").dropDuplicates(["d"]).mapInPandas(lambda b: counted(b, looked), "p string").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    for r in harmless.collect():
        if often[r.p] < precision * (often[r.p] + r.n):
            del often[r.p]
    shared = spark.sparkContext.broadcast(frozenset(often))
    at: dict[str, set[tuple]] = {p: set() for p in often}
    kinds: dict[str, Counter] = {p: Counter() for p in often}
    for r in bad.mapInPandas(places, f"p string, d {kind}, k long, c string").collect():
        at[r.p].add((r.d, r.k))
        kinds[r.p][r.c] += 1
    return tuple((p, max(sorted(kinds[p]), key=kinds[p].get)) for p in cover(at, support))


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """(by, documents, abusive, rate, mean_score); a null source is a source of its own."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("abusive_sentences") > 0, 1)).alias("abusive"), F.avg((F.col("abusive_sentences") > 0).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
