"""Surrogates for personal data: keyed, type-consistent, distinct and the same at every mention; DataFrame functions only.

Found by pattern: e-mail addresses, IPv4 and IPv6 addresses, IBANs, telephone numbers (a national one of ten digits is the one with +1), card-like numbers of 13 to 19 digits, social security numbers, and
names after titles (the capitalised words that follow them, also initials, words in capitals, parts joined by hyphens and lower-case particles between them).
Words of a name that was found so are replaced at every other mention in the same text too, with or without a title, capitalised or in
capitals, with initials before them; names that have no title anywhere in their text are not looked for. A name that is a common word too (a fixed list) stays where it
stands alone at the start of a sentence, one that is a month wherever it stands alone. Small-lettered names are found after abbreviated titles, names of scripts
without capitals after any title, and at other mentions where they stand between spaces.

An entity is what its mentions have in common: a name word without its case, an address without its case, a number's digits. Its
surrogate is drawn from an HMAC-SHA-512 of kind and entity and laid out in each mention's own format: digits, capitals and small letters stay what they are, in Latin,
Cyrillic, Greek or Armenian script; punctuation, e-mail top-level domains, dialling codes and cards' first digits stay; valid card check
digits stay valid, also those of an IBAN. One name word has one surrogate whatever its titles and places; it ends as the gender asks that titles give it in the whole corpus
(both or none: a neutral ending; never before another name: a surname's). The draw needs no table, so most texts are rewritten in one projection.

Collision checks run over the distinct entities of the whole corpus: where a surrogate equals another entity's, or is itself
a real entity, the entity draws again until it is distinct. From draw _GROW_AFTER on each draw is longer by a syllable, letter or group of
digits, so the space outgrows any number of entities and a distinct surrogate always comes; such surrogates keep their type, but not their length (an address
takes a port, a number another group of digits). Only texts with such an entity, or with a word whose role differs elsewhere, need a join.
Initials are replaced, but are no entities of their own.

The key is read from a one-row table by scalar subqueries, so it stands in no plan. Null texts stay null and have no entities. Rows are independent.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

TYPES = ("email", "ip", "phone", "card", "ssn", "name", "ipv6", "iban")
#: Titles and what they say of the gender.
MALE = ("Mr", "mr", "Sir", "Herr", "Herrn", "Señor", "señor", "Sr", "Don", "don", "Monsieur", "господин", "Господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "mrs", "Ms", "ms", "Miss", "Frau", "Señora", "señora", "Señorita", "señorita", "Sra", "Doña", "doña", "Madame", "Mme", "Mlle", "госпожа", "Госпожа", "Κυρία", "κυρία")
NEUTRAL = ("Dr", "dr", "Prof", "prof", "Rev", "rev")
#: Words that stand between names, names that are common words too, and those of them that are months; words that follow an abbreviated title and are no name.
PARTICLES = "de|del|la|las|los|von|van|der|den|da|di|du|le|y|e"
COMMON = "art bill bush case chance chase christian dawn dean destiny drew duke earl faith field forest frank gene glen grace grant green hill holly hope hunter iris ivy jack jasmine joy judge justice king lake lane law long mark mason melody miles miller mercy noble page pat pearl pierce porter price ray rich rob rock rose rusty ruby sandy short sky sterling stone sue summer taylor terry victor violet ward wade wells west white will wood woods young black brown baker cook carpenter hall day ford good".split()
MONTHS = "april august june march may avril mai mayo abril julio junio julia".split()[:10]
NO_NAME = "a an and are as asked at by came de did el en for from had has he her his i in is it la los me my no not of on or que said says she so that the they this to told un una was we went were who will with would y you".split()
_TITLES = "|".join(sorted({t for x in (*MALE, *FEMALE, *NEUTRAL) for t in (x, x.upper())}, key=lambda t: (-len(t), t)))
#: Syllables and endings that surrogate names are put together from, by script.
SCRIPTS = {
    "IsCyrillic": ("ба ва га да жа за ка ла ма на па ра са та фа ха бо во го до зо ко ло мо но по ро со то фо", {"given_m": "рон лин мир вид", "given_f": "лина рия нета вида", "given_n": "лен рин сел рис", "surname": "рель нсон менд гард"}),
    "IsGreek": ("βα γα δα ζα κα λα μα να πα ρα σα τα φα χα βο γο δο ζο κο λο μο νο πο ρο σο το φο χο", {"given_m": "ρος νος λης μης", "given_f": "ρια νια λια δα", "given_n": "λεν ριν σελ ρι", "surname": "ρελης νσος μοντης γαρδης"}),
    "IsArmenian": ("բա գա դա զա կա լա մա նա պա ռա սա տա ֆա բո գո դո զո կո լո մո նո պո ռո սո տո ֆո", {"given_m": "րոն լին միր վիդ", "given_f": "լինա րիա նետա վիդա", "given_n": "լեն րին սել րիս", "surname": "րելյան նսոնյան մենդյան գարդյան"}),
    "IsHan": ("佳 安 嘉 和 清 玉 志 明 文 美 秀 春 雨 石 田 森 竹 松 岡 原", {"given_m": "雄 剛 強 健", "given_f": "花 香 娜 芳", "given_n": "真 光 平 心", "surname": "野 本 村 井"}),
    "IsHiragana": ("か き さ し た ち な に は ひ ま み や ゆ ら り", {"given_m": "お と た け", "given_f": "こ え な み", "given_n": "る ん き り", "surname": "の も む い"}),
    "IsKatakana": ("カ キ サ シ タ チ ナ ニ ハ ヒ マ ミ ヤ ユ ラ リ", {"given_m": "オ ト タ ケ", "given_f": "コ エ ナ ミ", "given_n": "ル ン キ リ", "surname": "ノ モ ム イ"}),
    "IsHebrew": ("בא גל דו זה טל כר לב מי נו סר פא קו רי שי תא", {"given_m": "רון ליר מיר דור", "given_f": "לינה ריה נטה דית", "given_n": "לן רין סל רי", "surname": "רלי נסון מוני גרד"}),
    "IsArabic": ("با تا جا حا دا را زا سا شا صا طا فا قا كا لا ما نا", {"given_m": "رون لير مير ويد", "given_f": "لينة رية نتة ويدة", "given_n": "لن رين سل ري", "surname": "رلي نسون موني غرد"}),
    "IsDevanagari": ("का गा चा जा ता दा ना पा बा मा या रा ला वा सा", {"given_m": "रोन लिर मिर विद", "given_f": "लिना रिया नेता विदा", "given_n": "लेन रिन सेल रि", "surname": "रेल नसन मोन गार्ड"}),
    "": ("ba be bo ca ce co da de do fa fe fi ga go ha he ho ja jo ka ke la le lo ma me mi mo na ne no pa pe ra re ro sa se so ta te to va ve vi wa we za zo", {"given_m": "ron lf nor ric", "given_f": "lina ra netta ria", "given_n": "len rin sel ris", "surname": "rell nson mont gard"}),
}
#: Fixed value: countries' dialling codes that are not three digits long.
SHORT_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_W, _N = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Eight groups of hex digits, or fewer with one gap that stands for zeros; a digit must occur, so that names in program text are none.
_HEXES = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:{_HEXES}{{7}}|(?:{_HEXES}{{0,5}})?::(?:{_HEXES}{{0,5}})?)(?![\p{{L}}\p{{N}}:])"
IBAN = rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])"
EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
SSN = rf"{_W}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_N}"
CARD = rf"{_W}(?:[0-9]{{4}}[ -]){{3}}[0-9]{{1,7}}{_N}|{_W}[0-9]{{13,19}}{_N}"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}{_N}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}{_N}|{_W}[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_N}"
#: A possessive ending is not part of the word.
_NO_TITLE = rf"(?!(?:{_TITLES})(?:\.|{_N}))"
_MIXED = _NO_TITLE + r"\p{Lu}(?=[\p{L}'’-]*\p{Ll})[\p{L}'’-]*\p{L}(?<!['’]s)"
_CAPITALS = _NO_TITLE + r"\p{Lu}[\p{Lu}'’-]*\p{Lu}"
_PARTICLE = rf"(?: (?:{PARTICLES})(?= ))*"
_CASELESS = r"(?:\p{IsHan}{1,4}|(?:(?!\p{IsHan})[\p{Lo}\p{M}]){2,})"
_SMALL = rf"(?!(?:{'|'.join([*NO_NAME, PARTICLES])}){_N})\p{{Ll}}[\p{{L}}'’-]*\p{{L}}(?<!['’]s){_N}"
_WORD = rf"(?:{_MIXED}{_N}|(?:\p{{Lu}}\.)+(?![\p{{L}}\p{{N}}@_%+-]))"
NAME = rf"{_W}(?:(?:{_TITLES})\.? )+(?:(?:(?:{PARTICLES}) )*{_WORD}(?:{_PARTICLE} {_WORD})*(?: {_CAPITALS}{_N})?|{_CAPITALS}(?: {_CAPITALS})?{_N}|{_CASELESS}(?: {_CASELESS})?)|{_W}(?:mrs?|ms|dr|prof|rev)\. {_SMALL}"
ANY = f"{EMAIL}|{IPV6}|{IP}|{IBAN}|{SSN}|{CARD}|{PHONE}|{NAME}"
#: Words that may be another mention of a name, with initials before them; the second pattern takes small ones too.
_TOKEN = rf"{_W}(?:\p{{Lu}}\. ?)*(?:\p{{Lu}}[\p{{L}}\p{{M}}'’]*[\p{{L}}\p{{M}}](?<!['’]s)|[\p{{Lo}}\p{{M}}]+){_N}"
_SMALL_TOKEN = rf"{_W}\p{{Ll}}[\p{{L}}\p{{M}}'’]*[\p{{L}}\p{{M}}](?<!['’]s){_N}"
_INITIALS = r"^(?:\p{Lu}\. ?)+"
#: What stands before the first word of a sentence.
_BEGINS = r"[.!?…][\p{Pf}\p{Pe}\"']*\s+$|\n\s*$"
#: A text without any of these has no entity.
_QUICK = rf"[0-9@]|{_W}(?:{_TITLES})\.? \p{{L}}"
_TITLED = rf"^(?:(?:{_TITLES})\.? )+"
#: Draws of the entity's own length before the space grows.
_GROW_AFTER = 8
BROADCAST_ROWS = 100_000
#: Names of the columns that hold the padded key.
_INNER, _OUTER = "_pii_inner", "_pii_outer"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items) -> str:
    return f"array({', '.join(map(_q, items))})"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _kind(m: str) -> str:
    return f"CASE WHEN contains({m}, '@') THEN 'email' WHEN {m} RLIKE '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$' THEN 'ipv6' WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban' WHEN {m} RLIKE {_q('^[\\p{L}\\p{M}]')} THEN 'name' WHEN {m} RLIKE {_q(f'^(?:{_OCTET}\\.){{3}}{_OCTET}$')} THEN 'ip' WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' WHEN {m} RLIKE '^[+(]' OR length(regexp_replace({m}, '[^0-9]', '')) < 13 THEN 'phone' ELSE 'card' END"


def _entity(m: str, kind: str) -> str:
    """What all mentions of an entity other than a name have in common."""
    digits = f"regexp_replace({m}, '[^0-9+]', '')"
    return f"CASE {kind} WHEN 'email' THEN lower({m}) WHEN 'ipv6' THEN lower({m}) WHEN 'iban' THEN replace({m}, ' ', '') WHEN 'phone' THEN CASE WHEN {digits} RLIKE '^[0-9]{{10}}$' THEN concat('+1', {digits}) ELSE {digits} END WHEN 'card' THEN regexp_replace({m}, '[^0-9]', '') ELSE {m} END"


def _pieces(m: str) -> str:
    """A name without its title, as words and what stands between them."""
    return f"regexp_extract_all(regexp_replace({m}, {_q(_TITLED)}, ''), {_q("[\\p{L}\\p{M}'’]+|[^\\p{L}\\p{M}'’]+")}, 0)"


def _is_word(piece: str) -> str:
    return f"({piece} RLIKE {_q('^[\\p{L}\\p{M}].')} AND NOT {piece} RLIKE {_q(f'^(?:{PARTICLES})$')})"


def _titled_words(m: str) -> str:
    """The words of a titled name with the roles that it gives them."""
    title = f"regexp_extract({m}, {_q(f'^({_TITLES})')}, 1)"
    titles = lambda ts: ", ".join(_q(x) for t in ts for x in dict.fromkeys((t, t.upper())))
    role = f"CASE WHEN {title} IN ({titles(MALE)}) THEN 'given_m' WHEN {title} IN ({titles(FEMALE)}) THEN 'given_f' ELSE 'given_n' END"
    words = f"filter({_pieces(m)}, w -> w RLIKE {_q('^[\\p{L}\\p{M}]')} AND NOT w RLIKE {_q(f'^(?:{PARTICLES})$')})"
    return _let(words, "ws", f"filter(transform(ws, (w, k) -> named_struct('raw', w, 'entity', lower(w), 'role', CASE WHEN k = 0 AND size(ws) > 1 THEN {role} ELSE 'surname' END)), u -> length(u.raw) > 1)")


def _role(roles: str) -> str:
    """One role out of those that a word has been seen in."""
    has = lambda r: f"array_contains({roles}, '{r}')"
    return f"CASE WHEN {has('given_m')} AND NOT {has('given_f')} THEN 'given_m' WHEN {has('given_f')} AND NOT {has('given_m')} THEN 'given_f' WHEN {has('given_n')} OR {has('given_m')} THEN 'given_n' ELSE 'surname' END"


def _people(m: str) -> str:
    """The names of a text's titled matches: names (their entities), for each role those seen in it and all their spellings as |-joined texts, low (some is in small letters).

    Membership is a search in such a text, so a text of very many names has a fixed pattern and work that grows with its words, not with pairs of names.
    """
    found = f"flatten(transform(filter({m}, x -> {_kind('x')} = 'name'), x -> {_titled_words('x')}))"
    joined = lambda items: f"concat('|', array_join(array_distinct({items}), '|'), '|')"
    seen = ", ".join(f"'{r}', {joined(f"transform(filter(us, u -> u.role = '{r}'), u -> u.entity)")}" for r in ("given_m", "given_f", "given_n", "surname"))
    spelled = joined("flatten(transform(us, u -> array(u.raw, concat(upper(left(u.entity, 1)), substr(u.entity, 2)), upper(u.entity))))")
    return _let(found, "us", f"named_struct('names', array_distinct(transform(us, u -> u.entity)), {seen}, 'spelled', {spelled}, 'low', exists(us, u -> u.raw RLIKE {_q('^\\p{Ll}')}))")


def _role_here(entity: str) -> str:
    """The role of a name in its text."""
    has = lambda r: f"contains(people.{r}, concat('|', {entity}, '|'))"
    return f"CASE WHEN {has('given_m')} AND NOT {has('given_f')} THEN 'given_m' WHEN {has('given_f')} AND NOT {has('given_m')} THEN 'given_f' WHEN {has('given_n')} OR {has('given_m')} THEN 'given_n' ELSE 'surname' END"


def _byte(i: str) -> str:
    return f"cast(conv(substr(h, (2 * ({i})) % 128 + 1, 2), 16, 10) as int)"


def _mapped(text: str) -> str:
    """Every letter and digit of `text` (in small letters) drawn anew from h, the rest as it is."""

    def pick(chars: str) -> str:
        return f"substr({_q(chars)}, {_byte('i')} % {len(chars)} + 1, 1)"

    latin = "abcdefghijklmnopqrstuvwxyz"
    cases = [("[0-9]", "0123456789"), ("[a-z]", latin), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsArmenian}", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"\p{IsDevanagari}", "कखगघचछजटडतदनपबमयरलवसह"), (r"\p{IsHan}", "佳安嘉和清玉志明文美秀春雨石田森"), (r"\p{IsHiragana}", "かきさしたちなにはひまみやゆらり"), (r"\p{IsKatakana}", "カキサシタチナニハヒマミヤユラリ"), (r"\p{L}", latin), (r"\p{N}", "0123456789")]
    arms = " ".join(f"WHEN c RLIKE {_q(p)} THEN {pick(chars)}" for p, chars in cases)
    return f"array_join(transform(regexp_extract_all({text}, '(?s).', 0), (c, i) -> CASE {arms} ELSE c END), '')"


def _luhn(text: str) -> str:
    digits = f"reverse(transform(regexp_extract_all({text}, '[0-9]', 0), d -> cast(d as int)))"
    return f"aggregate(transform({digits}, (d, i) -> CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END), 0, (a, d) -> a + d)"


def _more(chars: str, end: int, begin: int = 0) -> str:
    """Further characters drawn from the end of h, as SQL arguments."""
    return ", ".join(f"substr({_q(chars)}, {_byte(str(63 - k % 32))} % {len(chars)} + 1, 1)" for k in range(begin, end))


def _name(entity: str, role: str, grow: int = 0) -> str:
    def build(syllables, endings):
        syl = _array(syllables)
        further = "".join(f"{syl}[{_byte(str(63 - k % 32))} % {len(syllables)}], " for k in range(grow))
        end = "CASE " + " ".join(f"WHEN {role} = {_q(k)} THEN {_array(v)}[{_byte('9')} % {len(v)}]" for k, v in endings.items()) + " END"
        two = f"({_byte('0')} * 256 + {_byte('1')})"
        return f"concat({syl}[{two} % {len(syllables)}], {syl}[{_byte('2')} % {len(syllables)}], {syl}[{_byte('3')} % {len(syllables)}], {further}{end})"

    built = {script: build(syl.split(), {k: v.split() for k, v in ends.items()}) for script, (syl, ends) in SCRIPTS.items()}
    arms = " ".join(f"WHEN {entity} RLIKE {_q(f'\\p{{{script}}}')} THEN {sql}" for script, sql in built.items() if script)
    return f"CASE {arms} ELSE {built['']} END"


def surrogate_sql(kind: str, entity: str, role: str, draw: str, grow: int = 0) -> str:
    """SQL of the draw-th surrogate of an entity, in the entity's own common form, longer by `grow` syllables, letters or groups of digits. The row holds the key."""
    letters = f"concat({_more('abcdefghijklmnopqrstuvwxyz', grow)}), " if grow else ""
    digits = f"concat({_more('0123456789', grow)})" if grow else "''"
    pairs = f"concat({_more('0123456789', 2 * grow)})" if grow else "''"
    groups = ", ".join(f"concat('-', {_more('0123456789', 2 * k + 2, 2 * k)})" for k in range(grow))
    port = f"concat(':', {_more('123456789', grow + 2)})" if grow else "''"
    email = f"concat({letters}{_mapped(f"regexp_extract({entity}, '(?s)^(.*)[.][^.]*$', 1)")}, regexp_extract({entity}, '[.][^.]*$', 0))"
    ip = f"concat(array_join(transform(split({entity}, '[.]'), (o, i) -> string({_byte('i')} % 254 + 1)), '.'), {port})"
    code = f"regexp_extract({entity}, '^[+](?:{SHORT_CODES}|[0-9]{{3}})', 0)"
    phone = _let(code, "cc", f"concat(cc, {_mapped(f'substr({entity}, length(cc) + 1)')}, {pairs})")
    drawn = f"concat(left({entity}, 1), {_mapped(f'substr({entity}, 2)')}, {digits})"
    checked = _let(f"concat(left({drawn}, length({entity}) + {grow - 1}), '0')", "z", f"concat(left(z, length(z) - 1), string((10 - {_luhn('z')} % 10) % 10))")
    card = f"CASE WHEN {_luhn(entity)} % 10 = 0 THEN {checked} ELSE {drawn} END"
    ssn = f"concat({_mapped(entity)}, {f'concat({groups})' if grow else "''"})"
    ipv6 = f"concat(array_join(transform(regexp_extract_all({entity}, '(?s).', 0), (c, i) -> CASE WHEN c = ':' THEN c ELSE substr('0123456789abcdef', {_byte('i')} % 16 + 1, 1) END), ''), {f'concat({groups})' if grow else "''"})"
    # the country stays, and so does the validity of the check digits
    account = f"concat(upper({_mapped(f'lower(substr({entity}, 5))')}), {digits})"
    value = "aggregate(regexp_extract_all(concat(z, left({0}, 2), '00'), '(?s).', 0), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)".format(entity)
    iban = _let(account, "z", f"concat(left({entity}, 2), lpad(string(98 - {value}), 2, '0'), z)")
    body = f"CASE {kind} WHEN 'ipv6' THEN {ipv6} WHEN 'iban' THEN {iban} WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'phone' THEN {phone} WHEN 'card' THEN {card} WHEN 'ssn' THEN {ssn} ELSE {_name(entity, role, grow)} END"
    message = f"encode(concat_ws('|', {kind}, {entity}, string({draw})), 'UTF-8')"
    return _let(f"sha2(concat({_OUTER}, unhex(sha2(concat({_INNER}, {message}), 512))), 512)", "h", body)


def laid_out(m: str, kind: str, s: str) -> str:
    """A surrogate in the format of a mention: its punctuation, its capitals; what a longer one has more goes to the end, or to an address's front."""
    digit = f"substr(d, length(regexp_replace(left({m}, i), '[^0-9]', '')) + 1, 1)"
    numbers = f"concat(array_join(transform(regexp_extract_all({m}, '(?s).', 0), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN {digit} ELSE c END), ''), CASE WHEN length(d) > n THEN concat(CASE WHEN {kind} = 'phone' THEN '-' ELSE '' END, substr(d, n + 1)) ELSE '' END)"
    # a national mention of a number is without the dialling code that its entity has
    national = f"{kind} = 'phone' AND NOT contains({m}, '+') AND startswith({s}, '+1') AND length(regexp_replace({m}, '[^0-9]', '')) = 10"
    places = f"substr({s}, length(regexp_replace(left({m}, i), '[^0-9A-Z]', '')) + 1, 1)"
    iban = f"concat(array_join(transform(regexp_extract_all({m}, '(?s).', 0), (c, i) -> CASE WHEN c RLIKE '[0-9A-Z]' THEN {places} ELSE c END), ''), substr({s}, length(replace({m}, ' ', '')) + 1))"
    numbers = _let(f"substr(regexp_replace({s}, '[^0-9]', ''), CASE WHEN {national} THEN 2 ELSE 1 END)", "d", _let(f"length(regexp_replace({m}, '[^0-9]', ''))", "n", numbers))
    cased = f"concat(left({s}, length({s}) - length({m})), array_join(transform(regexp_extract_all(right({s}, length({m})), '(?s).', 0), (c, i) -> CASE WHEN substr({m}, i + 1, 1) RLIKE {_q('\\p{Lu}')} THEN upper(c) ELSE c END), ''))"
    word = f"CASE WHEN {m} RLIKE {_q('^\\p{Ll}')} THEN {s} WHEN {m} RLIKE {_q('\\p{Ll}')} THEN concat(upper(left({s}, 1)), substr({s}, 2)) ELSE upper({s}) END"
    return f"CASE {kind} WHEN 'email' THEN CASE WHEN {m} = lower({m}) THEN {s} ELSE {cased} END WHEN 'phone' THEN {numbers} WHEN 'card' THEN {numbers} WHEN 'name' THEN {word} WHEN 'iban' THEN {iban} WHEN 'ipv6' THEN CASE WHEN {m} = upper({m}) THEN upper({s}) ELSE {s} END ELSE {s} END"


def _matches(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {_q(_QUICK)} THEN regexp_extract_all({text}, {_q(ANY)}, 0) ELSE cast(array() as array<string>) END"


def _units(m: str) -> str:
    """Distinct (kind, entity, role) of a text's first matches; roles are for names. Reads the row's people."""
    others = f"transform(filter({m}, x -> {_kind('x')} <> 'name'), x -> {_let(_kind('x'), 'k', f"named_struct('kind', k, 'entity', {_entity('x', 'k')}, 'role', '')")})"
    return f"concat(array_distinct({others}), transform(people.names, p -> named_struct('kind', 'name', 'entity', p, 'role', {_role_here('p')})))"


def key_table(spark, key: str | bytes) -> DataFrame:
    """The key as HMAC pads it: one row, whose values no plan shows."""
    raw = (key.encode() if isinstance(key, str) else key).ljust(128, b"\0")
    if len(raw) > 128:
        raise ValueError("the key has 128 bytes at most")
    return spark.createDataFrame([(bytearray(b ^ 0x36 for b in raw), bytearray(b ^ 0x5C for b in raw))], "inner binary, outer binary")


def with_key(df: DataFrame, key: str | bytes | DataFrame) -> DataFrame:
    """df with the columns that surrogate_sql reads. key: the key, or a table as key_table makes it."""
    table = key if isinstance(key, DataFrame) else key_table(df.sparkSession, key)
    return df.withColumns({_INNER: table.select("inner").scalar(), _OUTER: table.select("outer").scalar()})


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of the whole table, the role that a name word has over all of it, and whether some text alone would give another."""
    found = docs.select(F.expr(_matches("text")).alias("m")).where(F.size("m") > 0).withColumn("people", F.expr(_people("m")))
    each = found.select(F.inline(F.expr(_units("m")))).distinct()
    seen = each.groupBy("kind", "entity").agg(F.collect_set("role").alias("roles"))  # four roles at most
    return seen.select("kind", "entity", F.expr(f"CASE WHEN kind = 'name' THEN {_role('roles')} ELSE '' END").alias("role"), (F.size("roles") > 1).alias("mixed"))


def exceptions(docs: DataFrame, key: str | bytes | DataFrame) -> DataFrame:
    """(kind, entity, surrogate) of those whose first draw collides, with a draw that does not, and of name words whose role differs between texts."""

    def draw(df: DataFrame, n: int) -> DataFrame:
        sql = surrogate_sql("kind", "entity", "role", str(n), max(0, n - _GROW_AFTER + 1))
        return with_key(df, key).withColumn("surrogate", F.expr(sql)).drop(_INNER, _OUTER)

    all_ = materialize(draw(entities(docs), 0), "entities")
    real = all_.select("kind", F.col("entity").alias("surrogate"))
    nth = Window.partitionBy("kind", "surrogate").orderBy("entity")
    done, settled = None, None
    left = all_
    for n in count():
        if n:
            left = draw(left.select("kind", "entity", "role", "mixed"), n)
        clash = left.withColumn("nth", F.row_number().over(nth)).join(real.withColumn("is_real", F.lit(True)), ["kind", "surrogate"], "left")
        if settled is not None:
            clash = clash.join(settled.withColumn("is_taken", F.lit(True)), ["kind", "surrogate"], "left")
        taken = (F.col("nth") > 1) | F.col("is_real").isNotNull() | (F.col("is_taken").isNotNull() if settled is not None else F.lit(False))
        clash = materialize(clash.select("kind", "entity", "role", "mixed", "surrogate", taken.alias("again")), "draws")
        good = clash.where("NOT again")
        settled = good.select("kind", "surrogate") if settled is None else settled.unionByName(good.select("kind", "surrogate"))
        fixed = (good if n else good.where("mixed")).select("kind", "entity", "surrogate")
        done = fixed if done is None else done.unionByName(fixed)
        left = clash.where("again")
        if not left.limit(1).count():
            return done


def replace_pii(docs: DataFrame, key: str | bytes | DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions), and mentions by type, for every row."""
    other = materialize(exceptions(docs, key), "exceptions")
    rows = docs.select("doc_id", "text", F.expr(_matches("text")).alias("titled")).withColumn("people", F.expr(_people("titled")))
    rows = rows.withColumn("pattern", F.expr(f"CASE WHEN size(people.names) = 0 THEN {_q(ANY)} WHEN people.low THEN {_q(f'{ANY}|{_TOKEN}|{_SMALL_TOKEN}')} ELSE {_q(f'{ANY}|{_TOKEN}')} END"))
    rows = rows.withColumn("m", F.expr("CASE WHEN size(people.names) > 0 THEN regexp_extract_all(text, pattern, 0) ELSE titled END"))
    # a match that is neither titled nor of another type is a word, and a mention if it is spelled like a name of the text
    titled = f"x RLIKE {_q(_TITLED)} OR x RLIKE {_q(f'^(?:mrs?|ms|dr|prof|rev)[.] ')}"
    rows = rows.withColumn("kinds", F.expr(f"transform(m, x -> {_let(_kind('x'), 'k', f"CASE WHEN k = 'name' AND NOT ({titled}) THEN 'word' ELSE k END")})"))
    rows = rows.withColumn("gaps", F.expr("CASE WHEN size(m) > 0 THEN split(text, pattern, -1) END"))
    bare = f"regexp_replace(x, {_q(_INITIALS)}, '')"
    rows = rows.withColumn("hits", F.expr(f"transform(m, (x, i) -> kinds[i] <> 'word' OR contains(people.spelled, concat('|', {bare}, '|')))"))
    near = lambda i, gap: f"coalesce(get(hits, {i}) AND get(kinds, {i}) IN ('word', 'name') AND get(gaps, {gap}) IN (' ', '-'), false)"
    starts = f"(i = 0 AND trim(gaps[0]) = '') OR gaps[i] RLIKE {_q(_BEGINS)}"
    plainly = f"array_contains({_array(MONTHS)}, lower(x)) OR (array_contains({_array(COMMON)}, lower(x)) AND ({starts}))"
    alone = f"NOT {near('i - 1', 'i')} AND NOT {near('i + 1', 'i + 1')}"
    rows = rows.withColumn("used", F.expr(f"transform(m, (x, i) -> hits[i] AND NOT (kinds[i] = 'word' AND ({plainly}) AND {alone}))"))
    n = other.count()
    if n:
        # which texts mention an entity of the table: a map per text
        rows = rows.withColumn("version", F.xxhash64("text"))
        units = rows.where(F.size("titled") > 0).select("version", F.inline(F.expr(_units("titled"))))
        used = units.join(F.broadcast(other) if n <= broadcast_rows else other, ["kind", "entity"]).select("version", "kind", "entity", "surrogate")
        maps = materialize(used.distinct().groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "entity"), "surrogate"))).alias("fix")), "fixes")
        rows = rows.join(F.broadcast(maps) if maps.count() <= broadcast_rows else maps, "version", "left")
        known = lambda kind, entity: f"coalesce(try_element_at(fix, concat_ws('|', {kind}, {entity})), "
    else:
        known = lambda kind, entity: "coalesce("
    rows = with_key(rows, key)
    role = _role_here("lower(w)")
    word = _let(f"{known(_q('name'), 'lower(w)')}{surrogate_sql(_q('name'), 'lower(w)', role, '0')})", "s", laid_out("w", "'name'", "s"))
    # an initial is one letter of its script
    initial = _let(f"sha2(concat({_OUTER}, unhex(sha2(concat({_INNER}, encode(concat_ws('|', 'initial', w), 'UTF-8')), 512))), 512)", "h", f"upper({_mapped('lower(w)')})")
    name = f"concat(regexp_extract(x, {_q(_TITLED)}, 0), array_join(transform({_pieces('x')}, w -> CASE WHEN {_is_word('w')} THEN {word} WHEN w RLIKE {_q('^\\p{Lu}$')} THEN {initial} ELSE w END), ''))"
    plain = _let(_kind("x"), "k", _let(_entity("x", "k"), "e", _let(f"{known('k', 'e')}{surrogate_sql('k', 'e', _q(''), '0')})", "s", laid_out("x", "k", "s"))))
    new = f"transform(m, (x, i) -> CASE WHEN NOT used[i] THEN x WHEN kinds[i] IN ('name', 'word') THEN {name} ELSE {plain} END)"
    text = "CASE WHEN size(m) = 0 THEN text ELSE concat(array_join(transform(new, (x, i) -> concat(get(gaps, i), x)), ''), get(gaps, size(new))) END"
    # words of one name that follow each other are one mention
    first = "kinds[i] <> 'word' OR NOT coalesce(get(used, i - 1) AND get(kinds, i - 1) = 'word' AND gaps[i] IN (' ', '-'), false)"
    told = F.expr(f"filter(transform(m, (x, i) -> CASE WHEN used[i] AND ({first}) THEN replace(kinds[i], 'word', 'name') END), k -> k IS NOT NULL)")
    counts = [F.expr(f"cast(size(filter(told, k -> k = '{t}')) as long)").alias(f"n_{t}") for t in TYPES]
    rows = rows.withColumns({"new": F.expr(f"CASE WHEN size(m) > 0 THEN {new} END"), "told": told})
    return rows.select("doc_id", F.expr(text).alias("text"), F.expr("cast(greatest(size(told), 0) as long)").alias("n_entities"), *counts)
