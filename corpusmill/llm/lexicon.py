"""Lexicons of abusive, hateful and sexual language by role, in English, Uzbek and Russian, and the votes drawn from them.

An entry is a word or a few; `*` at its end stands for any ending. Entries are written as one spells them
and compared in the form of `cues.plain`, so one list serves both scripts. They are words of the languages
at large: none is the name of a person, people or thing of a corpus. Words of the labelled samples become
further lexicons when a model is fitted.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import ahocorasick

from . import cues

# The entries of each role.
ROLES: dict[str, str] = {
    "you": """you, your, yours, you're, you've, you'll, yourself, u, ur, sen, seni, senga, sening, sendan, sendek, sensan, siz kabi, odamsan, emassan, ekansan, yuzingga, boshingni, og'zingni, ovozingni, tilingni, qo'lingni, miyang*,
        ty, ты, тебя, тебе, тобой, твой, твоя, твою, твои, твоей, чтоб ты, чтобы ты, себя""",
    "insult": """idiot*, imbecile*, moron*, cretin*, dumbass*, halfwit*, half-wit*, loser*, parasite*, clown*, pig, pigs, swine, fool, fools, dimwit*, jerk*, scumbag*, scum, bastard*, asshole*, arsehole*, bitch*, whore*, slut*, dunce*, nitwit*, twit, twits,
        trash, garbage, filth, worm, worms, cockroach*, retard*, dummy, dummies, donkey*, prick, pricks, wanker*, blockhead*, dickhead*, shithead*, motherfucker*, simpleton*, coward*, rat, snake, snakes, weasel*, buffoon*, hag, brat, brats, scoundrel*, creep, creeps,
        freak, freaks, leech*, toad, cow, dog, vermin, dirtbag*, lowlife*, crybaby, numbskull*, airhead*, bonehead*, douche*, bum, skank*, degenerate*, nobody,
        eshak*, eshshak*, tentak*, nodon*, ahmoq, ahmoqsan*, ahmoqlar, ahmoqona, jinni*, iflos*, ablah*, yaramas*, hayvon, hayvonsan, cho'chqa*, it emgan, itvachcha*, galvars*, merov*, xunasa*, maraz*, kallavaram*, befarosat*, dangasa*, uyatsiz*, qo'rqoq*, haromi*, la'nati*, beaql*, aqlsiz*, xumpar*, nomard*, pastkash*, razil*, tuban*, ko'ppak*, kaltafahm*, to'nka*, landovur*,
        идиот*, придур*, мразь, мрази, дурак*, дура, дуры, дурой, кретин*, дебил*, сволоч*, скотин*, тварь, твари, тварью, урод*, подонок*, подонк*, ничтожеств*, козёл*, козел*, козл*, баран, барана, бездар*, гад, гады, гадин*, паскуд*, подлец*, вонючк*, мерзав*, негодя*, болван*, тупиц*, осёл, ослы, свинья, свиньи, шваль, падл*, гнид*, выродок*, ублюд*, лох, лохи, недоумок*, недоумк*, сука, суки, засран*, тряпк*, стерв*""",
    "scorn": """stupid, pathetic, filthy, disgusting, worthless, miserable, useless, brainless, dumb, dumber, dumbest, ugly, idiotic, moronic, hopeless, rotten, vile, nasty, lousy, spineless, stinking, lying, lazy, disgrace*, despicable, repulsive, clueless, gutless, talentless, wretched, slimy, sickening,
        jirkanch*, befoyda*, yaramas*, iflos*, ahmoq*, razil*, pastkash*, sassiq*, yaroqsiz*, hech narsaga yaramaydigan, miyasiz*, notavon*, xunuk*, la'nati*,
        тупой, тупая, тупые, тупого, жалк*, мерзк*, вонюч*, гнусн*, никчёмн*, никчемн*, отвратительн*, безмозгл*, бездарн*, набит*, полный, проклят*, подл*, паршив*, грязн*, глуп*""",
    "dismiss": """shut up, shut the, shut your, keep your mouth shut, get lost, go to hell, go jump, jump off a, go die, go away and, drop dead, just disappear, disappear for good, piss off, fuck off, fuck you, screw you, eat shit, crawl back, get out of here, get out of my, beat it, buzz off, go kill yourself, kill yourself, bite me, nobody asked you, go choke, choke on, rot in, burn in hell, watch your back,
        ovozingni o'chir*, yo'qol*, ko'zimdan, ko'rgani ko'zim, daf bo'l*, tilingni tiy*, og'zingni yop*, senga joy yo'q, tuyog'ingni, jo'nab qol*, jo'na, go'rga, o'lib ket*, qirilib ket*, jahannamga, bor yo'qol, o'l,
        заткни*, убирайся*, пошёл вон, пошел вон, пошла вон, пошёл ты, пошел ты, проваливай*, закрой рот, закрой свой, закрой свою, вали отсюда, катись*, отвали*, иди к чёрту, иди к черту, сгинь*, сдохни*, чтоб ты, подавись*, чтоб тебя, скройся с глаз, исчезни""",
    "belittle": """nobody likes, nobody wants, nobody needs, nobody loves, no one likes, no one wants, nobody would miss, no one would miss, everyone hates, everyone laughs, everybody hates, makes me sick, make me sick, waste of oxygen, waste of space, waste of air, waste of time, the size of a pea, no brain, no brains, half a brain, dumber than, a disgrace, deserve a beating, deserve to suffer, i hope you, wish you were dead, if you died, i hate you, i despise, never amount to, ashamed of yourself, your face, your mother, spit on,
        nafratlanaman, yuzingga tupur*, tupurdim, miyang yo'q, aqling yo'q, joy yo'q, kerak emassan, ko'rmaganman, senday, sendek, hech kim emassan, odam emassan,
        ненавижу, тебя ненавид*, все ненавид*, какой же ты, какая же ты, ну ты и, мозгов нет, мозгов совсем, мозгов у, никому не нужен, никому не нужна, позор, плюю на, тошнит от, чтоб ты сгнил""",
    "will": """i will, i'll, i am going to, i'm going to, i'm gonna, i shall, i would, gonna, i want to, i swear, we will, we'll, someone should, somebody should""",
    "violent": """kill, smash, break, hurt, beat, crush, punch, strangle, destroy, burn, slap, slit, stab, shoot, bury, choke, hunt you, find you, cut your, rip your, tear your, bone, bones, throat, skull, teeth, where you live""",
    "threat": """boshingni yor*, o'ldiraman, o'ldirib, uraman, sindiraman, sindirib, kaltaklayman, bo'g'aman, bo'g'ib, ko'maman, so'yaman, sug'urib olaman, sug'uraman, pichoqlayman, yoraman, yondiraman, ezaman, adabingni ber*, burningni, qo'lingni sindir*,
        убью, прибью, зарежу, оторву, сломаю, закопаю, порву, придушу, задушу, размажу, изобью, побью, урою, уничтожу, раздавлю, выбью, пристрелю, голову оторву, шею сверну, найду тебя, убить тебя, smash your, break your, slit your, your throat, your skull""",
    "dehuman": """vermin, rats, rat, cockroach*, parasite*, parasites, subhuman*, animals, animal, beasts, beast, plague, disease, cancer, pests, pest, infest*, not human, not even human, no humans, not people, lice, insects, insect, maggot*, leeches, swarm*, savage*, breed like, filth, filthy, scum, dirty, thieving, brutes, barbarian*, apes, monkeys, locusts,
        kalamush*, odam emas*, odammas*, hasharot*, parazit*, hayvon*, iflos*, balo, maraz*, la'nati*, itlar, suvarak*, qurt, buzuq*, vabo,
        не люди, нелюд*, крысы, крыс, крыса, звери, зверь, паразит*, тараканы, тараканов, отродье, скот, животные, зараза, чума, саранча, грязн*, паршив*, вши, стадо, твари, мразь, выродк*""",
    "is": """are, is, were, was, nothing but, like, just, not, hammasi, xuddi, emas, ular, barchasi, bir, как, это, не, просто, хуже""",
    "must": """should, must, ought to, need to, have to, has to, deserve, let us, let's, we will, time to, kerak, lozim, shart, darkor, надо, нужно, пора, должны, следует, давно пора""",
    "group": """people, folk, folks, tribe*, race, races, nation*, immigrant*, migrant*, refugee*, foreigner*, foreign, outsider*, newcomer*, stranger*, settler*, nomad*, believer*, unbeliever*, infidel*, heathen*, heretic*, pagan*, women, woman, savages, native*, villager*, dweller*, minorit*, communit*, their kind, those people, they, them, their, southerner*, northerner*, easterner*, westerner*, islander*, ethnic*, barbarian*, all the, all of them, every last, all those, all these,
        muhojir*, qochqin*, kelgindi*, musofir*, dindor*, xalq*, millat*, irq*, qabila*, ayollar*, xotinlar*, chet ellik*, begona*, ular, ularni, ularning, barcha, hammasi, hammasini, bunday, yotlar*,
        мигрант*, бежен*, приезж*, народ*, раса, расы, чужак*, инород*, иностран*, горц*, горцы, кочевник*, женщин*, племен*, племя, иммигрант*, пришельц*, чужеземц*, эти, этих, они, их, все, всех, им""",
    "expel": """driven out, drive out, drive them, driven from, round up, rounded up, kick out, kicked out, kick them, throw out, thrown out, deport*, banish*, exterminat*, wipe out, wiped out, wipe them, get rid of, keep them away, keep away, burn their, burn down, burned alive, burnt alive, out of every, out of our, send them back, back where they came, go back to where, lock up all, lock them up, cleanse*, eradicat*, hang them, hanged, shot, gassed, a bullet, don't deserve to live, deserve to die, not deserve to live, be cut out, eliminat*, no place among,
        haydash*, haydab*, haydal*, quvib*, quvish*, yoqish kerak, yoqib, qirib tashla*, otish kerak, otib tashla*, osish kerak, uyini yoq*, uylarini yoq*, yashashga haqqi yo'q, yo'q qilish*, tozalash*, o'lishi kerak, ishonib bo'lmaydi, chiqarib tashla*,
        гнать, прогнать, выгнать, изгнать, сжечь, истреб*, вешать, повесить, расстрел*, выслать, депортир*, уничтож*, очистим, очистить, недостоин жить, недостойны жить, не должны жить, нельзя доверять, вырезать, перебить""",
    "taint": """poison this, poison our, poisons our, poisoning our, poison the, ruin this, ruining our, ruin our, ruins our, destroying our, stealing our, invading, infect*, on this nation, on our nation, on our society, our country, this country, our land, our blood, our nation, never let my, sit next to, live among, breed like, breed as,
        yurtimiz*, yurtni, yurtdan, yurt, vatanimiz*, bulg'a*, jamiyatning, jamiyatimiz*, shahrimiz*, ko'payib, ko'payadi, urchi*, qoni,
        отравля*, нашу страну, нашу землю, страну, страны, наш город, заразили, плодятся, размножа*, нашей земле, на теле, нашу кровь""",
    "inferior": """inferior*, lesser race, second class, second-class, dirty blood, impure, unclean, subhuman*, uncivili*, primitive beings, their blood, not equal to us, lower race, master race,
        past irq, irq past, past mavjudot*, qoni buzuq, past millat, tuban xalq, ikkinchi nav*,
        низш*, второго сорта, грязная кровь, неполноценн*, недочеловек*, своё место, свое место""",
    "blame": """all liars, all thieves, all criminals, liars, thieves, criminals, terrorists, never trust, nothing but, are all, rapists, murderers, traitors,
        o'g'ri, o'g'rilar, jinoyatchi*, yolg'onchi*, xoin*, firibgar*, qotil*, hammasi o'g'ri,
        воры, вор, преступник*, лжец*, лгун*, предател*, бандит*, убийц*, обманщик*""",
    "explicit": """porn*, nudes, horny, orgasm*, cock, cocks, dick, dicks, pussy, tits, titties, boobs, blowjob*, cum, cumshot*, came all over, anal, erotic*, masturbat*, fuck me, fuck her, fuck him, fucking her, fucked her, fucked, xxx, milf, striptease, hookup*, sex, sexy, sex tape, dildo*, penis, vagina, clit*, nipples, nipple, threesome*, gangbang*, escort girls, call girls, naughty, inside you, inside me, inside her, from behind, make love, made love, get so wet, so wet, hardened, thrust*, foreplay, kinky, fetish*,
        seks, seksi, seksual*, pornografi*, porno, shahvat*, shahvoniy*, behayo*, jinsiy aloqa*, ehtirosli*, ehtiros*, yotmoqchiman, yotaylik, intim*, erotik*, orgazm*, minet*,
        порно, порнух*, секс, секса, сексу, сексом, оргазм*, эроти*, минет*, член, трах*, интимн*, кончил*, кончаю, возбужд*, переспать, мокрая, войди в меня, сексуальн*, развратн*, похотлив*""",
    "coarse": """nudes, horny, pussy, tits, titties, boobs, blowjob*, cumshot*, came all over, fuck me, fuck her, fuck him, fucking her, fucked her, xxx, milf, dildo*, gangbang*, threesome*, call girls, sex tape, porn clips, porn video*, naughty, get so wet, big cock, sucked them, inside you, inside me, kinky, sex chat, hot girls, hookup*,
        jinsiy aloqa qil*, yotmoqchiman, shahvatga, minet*, behayo*, ehtirosli*, seks video*, qaynoq seks, porno, pornofilm*, pornosayt*,
        порнух*, трах*, минет*, кончил*, кончаю, переспать, войди в меня, вся мокрая, секс без, хочу секса, горячее порно, интимные фот*""",
    "nude": """naked, nude, undress*, topless, panties, bra, lingerie, underwear, bare breasts, bare body, barely dressed, strip, stripped, stripping, tore off, ripped off, took off, clothes, without clothes,
        yalang'och*, yechin*, yechib, yechint*, kiyimlarini, kiyimini, ich kiyim*,
        голые, голая, голую, голый, голых, обнаж*, раздева*, раздет*, разде*, трусик*, лифчик*, бельё, без одежды""",
    "body": """breasts, breast, thigh, thighs, lips, bed, bodies, body, buttocks, ass, butt, neck, legs, crotch, groin, skin, tongue, face, hips, curves,
        badan*, ko'krak*, tana*, tanasini, son, sonlarini, lab, lablar*, lablaring*, to'shak*, bo'yn*, beli, rasmlaring*, rasmingni,
        грудь, груди, бёдра, бедра, бёдер, губы, губ, тело, телом, тела, живот, постел*, ягодиц*, ножки, попк*, фото, фотк*""",
    "touch": """lick*, moan*, suck*, caress*, kiss*, touch myself, touch you, touch yourself, stroke*, fondl*, grop*, ride you, ride me, ride him, straddl*, spread her, spread your, begged him, begged her, gasp*, sweating, pleasure, panting, slid his, slid her, feel you, taste you, whisper*, every inch, lust*, desire you, aroused, arous*, seduc*, hungrily, loud,
        yala*, yalab, silab, silash, o'pdi, o'pib, o'pmoq*, quchoq*, ingra*, titrab, nafasi, huzur*, erkala*, tortdi, qaynoq,
        ласкал*, ласка*, стонал*, застонал*, стон*, целовал*, целу*, лиза*, облиз*, страст*, желани*, гладил*, наслажден*, сверху, горяч*, хочу тебя, хочу секса, возбуд*""",
    "solicit": """send me, show me, watch me, watch my, come to my, come over, adults only, adult models, adult video*, adult, click here, click for, webcam, live girls, hot girls, lonely wife, uncensored, tonight, all night, private chat, sex chat, no strings, no questions asked, free clips, clips, waiting for your call, call me, on camera, looking for, want to, wants a, i want, cam show, baby,
        menga, yubor*, tashla, faqat kattalar*, kattalar uchun, kattalarga, bosing, qo'ng'iroq qil*, bu kecha, bir kecha, seni kut*, issiq qizlar, qizlar videosi, video*, 18 yosh*, istayman, kelyapti, moqchiman, chiqmoqchi*,
        пришли мне, скинь, покажи, приходи ко мне, для взрослых, только для взрослых, без цензуры, без обязательств, видеочат, звони, этой ночью, хочу, девушки, красотк*, студентк*, жми сюда, прямо сейчас, сними""",
    "scholarly": """chapter, study, studies, survey*, table, law, laws, theory, theories, experiment*, research*, history, historical, archive*, statistic*, sample*, data, method*, concept*, define*, definition*, measured, counted, compares, compared, discusses, discussed, analy*, describes, described, explain*, argument*, argues, philosoph*, court, century, novel, article, section, handbook, column, variable, proof, census, chronicle, treated, books, meant, term, process, key, signal, logic*, organism, species, cell, selection, legislation, censorship,
        bob, bobda, asar*, tadqiqot*, tajriba*, qonun*, nazariya*, o'rganil*, tahlil*, tushuncha*, solishtiril*, hisoblan*, jadval*, so'rov*, tavsif*, ko'riladi, tushuntiril*, dalil*, mantiqiy*, isbot*, organizm*, hujayra*, harorat*, falsafiy*, o'rtacha,
        глав*, исследован*, закон*, теори*, эксперимент*, опыт*, таблиц*, истори*, статисти*, сравнива*, объясня*, понят*, роман*, суд, век*, вывод*, отбор*, означа*, процесс*, хозяин*, права, ускорени*, провод""",
}

#: Voters: category, vote, and what must stand in the sentence: roles joined by & within NEAR characters of each other, alternatives by |.
#: `plural` is a mention of many, by articles and endings.
VOTERS: dict[str, tuple[str, int, str]] = {
    "insult": ("abusive", 1, "insult"),
    "scorn": ("abusive", 1, "scorn"),
    "scorned_insult": ("abusive", 1, "scorn&insult"),
    "addressed": ("abusive", 1, "you&insult|you&scorn"),
    "dismissal": ("abusive", 1, "dismiss"),
    "belittled": ("abusive", 1, "belittle&you|belittle&insult|belittle&scorn"),
    "threat": ("abusive", 1, "will&violent&you|threat"),
    "second_person": ("abusive", 1, "you"),
    "sampled_abusive": ("abusive", 1, "sampled_abusive&sampled_abusive"),
    "scholarly_abusive": ("abusive", -1, "scholarly"),
    "dehumanised": ("hateful", 1, "dehuman&group|dehuman&plural"),
    "called_less": ("hateful", 1, "is&dehuman&group|is&dehuman&plural"),
    "expelled": ("hateful", 1, "expel&group|expel&plural"),
    "to_be_expelled": ("hateful", 1, "must&expel&group|must&expel&plural"),
    "expelled_vermin": ("hateful", 1, "expel&dehuman|expel&inferior|expel&blame|expel&taint"),
    "tainted": ("hateful", 1, "taint&dehuman|taint&group&blame|taint&inferior|taint&expel&group"),
    "inferior": ("hateful", 1, "inferior"),
    "blamed": ("hateful", 1, "blame&group|blame&plural"),
    "sampled_hateful": ("hateful", 1, "sampled_hateful&sampled_hateful"),
    "spoken_to": ("hateful", -1, "you"),
    "scholarly_hateful": ("hateful", -1, "scholarly"),
    "explicit": ("sexual", 1, "explicit"),
    "coarse": ("sexual", 1, "coarse"),
    "sensual": ("sexual", 1, "touch&touch"),
    "touched": ("sexual", 1, "touch&body|touch&nude|touch&explicit"),
    "bared": ("sexual", 1, "nude&body|explicit&body|explicit&nude"),
    "solicited": ("sexual", 1, "solicit&explicit|solicit&nude|solicit&touch|solicit&body&you"),
    "sampled_sexual": ("sexual", 1, "sampled_sexual&sampled_sexual"),
    "scholarly_sexual": ("sexual", -1, "scholarly"),
}
CATEGORIES = ("abusive", "hateful", "sexual")
NEAR = 90
#: Where a mention of many is looked for: only in sentences in which one of these roles stands.
_MANY = ("dehuman", "expel", "blame")
_PLURAL = re.compile(r"\b(?:the|these|those|all|every|of) (?:\w+ ){0,2}\w{2,}s\b|\w{3,}lar(?:ni|ning|dan|ga|i)?\b|^ ?[a-z]{3,}s (?:are|breed|should|must|deserve)\b|\ban? \w{3,}ian\b")


def _terms(rule: str) -> list[tuple[str, ...]]:
    return [tuple(x.split("&")) for x in rule.split("|")]


def entries(role: str) -> list[str]:
    return [" ".join(x.split()) for x in ROLES[role].split(",") if x.strip()]


@functools.lru_cache(maxsize=8)
def voting(sampled: tuple[tuple[str, tuple[str, ...]], ...]) -> Voting:
    return Voting(sampled)


class Voting:
    """The voters, with the words of the labelled samples: (category, words) each."""

    def __init__(self, sampled: tuple[tuple[str, tuple[str, ...]], ...]):
        self.names = [*ROLES, "plural", *[f"sampled_{c}" for c in CATEGORIES]]
        bit = {name: 1 << i for i, name in enumerate(self.names)}
        table: dict[str, int] = {}
        own = {f"sampled_{c}": list(words) for c, words in sampled}
        for role in self.names:
            for entry in own.get(role, entries(role) if role in ROLES else []):
                stem = entry.endswith("*")
                text = tidy(bare(entry.rstrip("*")))
                text = f" {text}" if stem else f" {text} "
                table[text] = table.get(text, 0) | bit[role]
        self.automaton = ahocorasick.Automaton()
        for text, roles in table.items():
            self.automaton.add_word(text, (roles, len(text)))
        self.automaton.make_automaton()
        self.many = sum(bit[r] for r in _MANY)
        self.plural = bit["plural"]
        # a voter's alternatives: (all its roles, each of them)
        self.rules = [(c, vote, [(sum({bit[r] for r in term}), [bit[r] for r in term]) for term in _terms(rule)]) for c, vote, rule in VOTERS.values()]
        #: Rules that sentences with these roles may meet.
        self.may: dict[int, list] = {}
        self.place = {c: [i for i, v in enumerate(VOTERS.values()) if v[0] == c] for c in CATEGORIES}

    def votes(self, sentences: list[str]) -> list[tuple[int, ...] | None]:
        """Of every sentence, in the form of `bare`, the votes of all voters; None where all abstain."""
        out: list[tuple[int, ...] | None] = [None] * len(sentences)
        starts, at = [], 0
        for s in sentences:
            starts.append(at)
            at += len(s) + 3
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (roles, length) in self.automaton.iter(" " + " \n ".join(sentences) + " "):
            i = bisect_right(starts, end - length + 1) - 1
            if i in hits:
                hits[i].append((roles, end))
            else:
                hits[i] = [(roles, end)]
        for i, found in hits.items():
            there = 0
            for roles, _ in found:
                there |= roles
            if there & self.many and _PLURAL.search(sentences[i]):
                there |= self.plural
            may = self.may.get(there)
            if may is None:
                may = self.may[there] = [(k, vote, terms) for k, (_, vote, rule) in enumerate(self.rules) if (terms := [each for every, each in rule if there & every == every])]
            if may:
                out[i] = self._cast(found, may)
        return out

    def _cast(self, hits: list[tuple[int, int]], may: list[tuple[int, int, list[list[int]]]]) -> tuple[int, ...] | None:
        cast = [0] * len(self.rules)
        some = False
        for k, vote, terms in may:
            for each in terms:
                if len(each) == 1 or self._near(hits, each):
                    cast[k] = vote
                    some = True
                    break
        return tuple(cast) if some else None

    def _near(self, hits: list[tuple[int, int]], each: list[int]) -> bool:
        """Hits of all roles, of different words, within NEAR characters."""
        each = [b for b in each if b != self.plural]
        if len(each) == 1:
            return True
        first = [e for r, e in hits if r & each[0]]
        for e in first:
            if all(any(r & b and x != e and abs(x - e) <= NEAR for r, x in hits) for b in each[1:]):
                return True
        return False


_ASCII = {c: 0x20 for c in range(128) if not (chr(c).isalnum() or chr(c) in "'\n")} | {0x60: "'"}
_OTHER = re.compile(r"[^\w'\n]+|_")


def bare(text: str) -> str:
    """The form of `cues.plain`, blanks for marks; line feeds stay."""
    if text.isascii():
        return text.lower().translate(_ASCII)
    return _OTHER.sub(" ", cues.latin(cues.unscripted(text)))


def tidy(text: str) -> str:
    """Single blanks, none at the ends."""
    return " ".join(text.split())
