"""Column functions on message texts, identifiers and payloads. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two markers, by severity, and the characters that make up a word around them.
MARKERS = {"offrecord": "#offrecord", "nomem": "#nomem"}
_WORD = r"[\p{L}\p{N}_]"


def has_marker(text: Column, marker: str) -> Column:
    """A marker that is no part of a longer word, in any case; null text has none."""
    return F.coalesce(F.regexp_like(text, F.lit(rf"(?iu)(?<!{_WORD}){marker}(?!{_WORD})")), F.lit(False))


def policy(*texts: Column) -> Column:
    """offrecord, nomem or normal: the severest marker in any of the texts."""
    found = {name: F.lit(False) for name in MARKERS}
    for t in texts:
        found = {name: x | has_marker(t, MARKERS[name]) for name, x in found.items()}
    return F.when(found["offrecord"], "offrecord").when(found["nomem"], "nomem").otherwise("normal")


# The parts of a message that are searched for markers, and the name of the rule.
POLICY_PARTS = ["text", "caption", "poll_question", "contact_name", "forward_text", "forward_caption"]
DETECTED_BY = "deterministic_token_match_v1"


def policy_audit(**parts: Column) -> Column:
    """Struct of policy, detected_by and, for each part, whether it holds the marker that decided (null for normal).

    parts: any of POLICY_PARTS; what isn't given is empty.
    """
    given = {name: parts.get(name, F.lit(None).cast("string")) for name in POLICY_PARTS}
    decided = policy(*given.values())
    marked = decided != "normal"
    hit = lambda t: F.when(decided == "offrecord", has_marker(t, MARKERS["offrecord"])).when(marked, has_marker(t, MARKERS["nomem"]))
    return F.struct(decided.alias("policy"), F.when(marked, DETECTED_BY).alias("detected_by"), *[hit(t).alias(f"in_{name}") for name, t in given.items()])


def contact_name(first: Column, last: Column) -> Column:
    """Those of both names that aren't empty, joined; null if neither is."""
    some = F.filter(F.array(first, last), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(some) > 0, F.array_join(some, " "))


def json_string(text: Column) -> Column:
    """text as a compact JSON string, characters past ASCII kept as they are."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in (*range(8), 11, *range(14, 32)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


#: How deep objects and lists may stand in each other in canonical_json; what is deeper ends the job, so that no hash leaves it out.
JSON_DEPTH = 6


def canonical_json(v: Column, depth: int = JSON_DEPTH, nulls: bool = False, spaced: bool = False) -> Column:
    """JSON of a variant with the keys of objects in order and characters past ASCII kept. nulls: whether keys whose value is null
    are kept. spaced: whether blanks stand behind commas and colons.

    Objects and lists are both a list of (key, value), so a level adds one expression. Numbers are written as the variant has them:
    whole numbers and decimals without an exponent.
    """
    kind = F.schema_of_variant(v)
    whole = lambda t: F.try_variant_get(v, "$", t)
    plain = F.when(kind == "STRING", json_string(whole("string"))).when(kind == "VOID", "null").otherwise(whole("string"))
    if not depth:
        return F.when(kind.rlike("^(OBJECT|ARRAY)"), F.raise_error(F.lit(f"JSON is nested deeper than {JSON_DEPTH}"))).otherwise(plain)
    # Objects as sorted (key, value) and lists as (null, value), so that a level stands once in the expression.
    entries = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.try_element_at(m, k).alias("value")))
    fields = let(whole("map<string,variant>"), entries)
    if not nulls:
        fields = F.filter(fields, lambda e: F.schema_of_variant(e["value"]) != "VOID")
    comma, colon = (", ", ": ") if spaced else (",", ":")
    items = F.transform(whole("array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    inner = F.when(kind.startswith("OBJECT"), fields).when(kind.startswith("ARRAY"), items)
    each = F.transform(inner, lambda e: F.concat(F.coalesce(F.concat(json_string(e["key"]), F.lit(colon)), F.lit("")), canonical_json(e["value"], depth - 1, nulls, spaced)))
    body = F.array_join(each, comma)
    return F.when(kind.startswith("OBJECT"), F.concat(F.lit("{"), body, F.lit("}"))).when(kind.startswith("ARRAY"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(plain)


def _as_variant(e: Column) -> Column:
    """An entity, a struct or a variant, as a variant without null fields."""
    return F.parse_json(F.to_json(e))


def _span(v: Column) -> list[Column]:
    """Offset, length and type of an entity, with what counts where they are missing."""
    get = lambda name, kind, none: F.coalesce(F.try_variant_get(v, f"$.{name}", kind), F.lit(none))
    return [get("offset", "int", 0), get("length", "int", 0), get("type", "string", "")]


def entities_json(entities: Column) -> Column:
    """Entities (array of structs or variants) with all they hold (url, language, user, ...) as a compact JSON list, sorted by
    offset, length and type, then by their place; keys in order, nulls left out. A null or empty list is []."""
    one = lambda e, i: let(_as_variant(e), lambda v: F.struct(*[x.alias(n) for x, n in zip(_span(v), "olt")], i.alias("i"), canonical_json(v, 3).alias("json")))
    sorted_ = F.array_sort(F.transform(entities, one))
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(sorted_, lambda x: x["json"]), ","), F.lit("")), F.lit("]"))


def content_hash(text: Column, caption: Column, kind: Column, entities: Column | None = None) -> Column:
    """Digest of a message: SHA-256 of the compact JSON list of version tag, text, caption, kind, entities."""
    parts = [F.coalesce(text, F.lit("")), F.coalesce(caption, F.lit("")), F.when(F.coalesce(kind, F.lit("")) == "", "text").otherwise(kind)]
    listed = F.lit("[]") if entities is None else entities_json(entities)
    return F.sha2(F.concat(F.lit('["chv1",'), *[x for p in parts for x in (json_string(p), F.lit(","))], listed, F.lit("]")), 256)


def merge_entities(*lists: Column) -> Column:
    """Entities (structs or variants) of the lists in order, the first of each offset, length and type; null if there are none."""
    every = F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    span = lambda e: let(_as_variant(e), lambda v: F.struct(*[x.alias(n) for x, n in zip(_span(v), "olt")]))
    firsts = lambda every: let(F.transform(every, span), lambda spans: F.filter(every, lambda e, i: F.array_position(spans, spans[i]) == i + 1))
    first = let(every, firsts)
    return F.when(F.size(first) > 0, first)


# The published Snowball list of Russian words that say little.
RUSSIAN_STOP_WORDS = [
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же",
    "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "теперь", "когда", "даже",
    "ну", "вдруг", "ли", "если", "уже", "или", "ни", "быть", "был", "него", "до", "вас", "нибудь", "опять", "уж", "вам", "ведь", "там",
    "потом", "себя", "ничего", "ей", "может", "они", "тут", "где", "есть", "надо", "ней", "для", "мы", "тебя", "их", "чем", "была", "сам",
    "чтоб", "без", "будто", "чего", "раз", "тоже", "себе", "под", "будет", "ж", "тогда", "кто", "этот", "того", "потому", "этого", "какой",
    "совсем", "ним", "здесь", "этом", "один", "почти", "мой", "тем", "чтобы", "нее", "сейчас", "были", "куда", "зачем", "всех", "никогда",
    "можно", "при", "наконец", "два", "об", "другой", "хоть", "после", "над", "больше", "тот", "через", "эти", "нас", "про", "всего", "них",
    "какая", "много", "разве", "три", "эту", "моя", "впрочем", "хорошо", "свою", "этой", "перед", "иногда", "лучше", "чуть", "том",
    "нельзя", "такой", "им", "более", "всегда", "конечно", "всю", "между",
]


# Endings of the published Snowball stemmer for Russian; those of the first kind count after а or я alone.
_GERUND = ("(?<=[ая])(вшись|вши|в)", "ившись|ивши|ив|ывшись|ывши|ыв")
_ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
_PARTICIPLE = ("(?<=[ая])(ем|нн|вш|ющ|щ)", "ивш|ывш|ующ")
_VERB = ("(?<=[ая])(ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)", "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю")
_NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
_VOWELS = "аеиоуыэюя"


def russian_stem(word: Column) -> Column:
    """Stem of a lower-case Russian word by regular expressions in the JVM; words without Russian vowels stay as they are."""

    def cut(region: Column, ending: str) -> Column:
        # The vowel before the region may be what an ending of the first kind looks back at, but only inside the region.
        return F.regexp_replace(region, f"({ending})$", "")

    # Each step is bound once (let): named by several later ones, it would be computed again for each.
    def inflected(rest: Column) -> Column:
        by_verb = lambda plain: let(cut(plain, "|".join(_VERB)), lambda verb: F.when(verb != plain, verb).otherwise(cut(plain, _NOUN)))
        adjectival = lambda plain: let(cut(plain, f"(({'|'.join(_PARTICIPLE)})?({_ADJECTIVE}))"), lambda cutoff: F.when(cutoff != plain, cutoff).otherwise(by_verb(plain)))
        return let(cut(rest, "|".join(_GERUND)), lambda gerund: F.when(gerund != rest, gerund).otherwise(let(cut(rest, "ся|сь"), adjectival)))

    def derived(head: Column, second: Column) -> Column:
        # Derivational endings count in the second region alone: after a vowel and a consonant, twice.
        inner = F.regexp_extract(F.concat(head, second), f"^[^{_VOWELS}]*[{_VOWELS}]+[^{_VOWELS}].*?[{_VOWELS}][^{_VOWELS}](.*)$", 1)
        third = F.when(F.regexp_like(inner, F.lit("(ость|ост)$")), cut(second, "ость|ост")).otherwise(second)
        return let(third, lambda third: let(cut(third, "ейше|ейш"), lambda superlative: let(F.regexp_replace(superlative, "нн$", "н"), lambda doubled: F.when((superlative != third) | (doubled != superlative), doubled).otherwise(cut(third, "ь")))))

    def stemmed(word: Column, head: Column) -> Column:
        rest = F.substring(word, F.length(head) + 1, F.length(word))
        return F.concat(head, let(cut(let(rest, inflected), "и"), lambda second: derived(head, second)))

    first = lambda word: F.regexp_extract(word, f"^[^{_VOWELS}]*[{_VOWELS}]", 0)
    return let(F.replace(word, F.lit("ё"), F.lit("е")), lambda word: let(first(word), lambda head: F.when(head == "", word).otherwise(stemmed(word, head))))


def search_tokens(*texts: Column) -> Column:
    """Lower-case words of the texts, in order."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalize_query(query: Column, limit: int = 256) -> Column:
    return F.trim(F.substring(F.trim(query), 1, limit))


def tombstone_keys(chat_id: Column, message_id: Column, content_hash: Column, user_id: Column) -> Column:
    """Keys by which an erasure may name a message, with their priority; keys with a null part are left out."""
    keys = [
        (1, F.concat(F.lit("message:"), chat_id.cast("string"), F.lit(":"), message_id.cast("string"))),
        (2, F.concat(F.lit("message_hash:"), content_hash)),
        (3, F.concat(F.lit("user:"), user_id.cast("string"))),
    ]
    return F.filter(F.array(*[F.struct(F.lit(p).alias("priority"), k.alias("key")) for p, k in keys]), lambda x: x["key"].isNotNull())


# Media types of the export format and the kinds they stand for; kinds whose text is a caption.
MEDIA_TYPES = {"photo": "photo", "video_file": "video", "voice_message": "voice", "audio_file": "audio", "sticker": "sticker", "animation": "animation", "video_message": "video_note"}
MEDIA_KINDS = ["photo", "video", "voice", "audio", "document", "sticker", "animation", "video_note"]


def message_kind(m: str = "", names: list[str] | None = None) -> Column:
    """Kind of an exported message (columns of an export, after an optional prefix such as "message."). names: the columns
    there are; others count as absent."""
    c = lambda name: F.col(f"{m}{name}") if names is None or name in names else F.lit(None).cast("string")
    given = lambda name: F.coalesce(c(name), F.lit("")) != ""
    by_media = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    kind = (
        F.when(c("type") == "service", "service")
        .when(c("forwarded_from").isNotNull(), "forward")
        .when(c("media_type").isNotNull(), F.coalesce(F.try_element_at(by_media, c("media_type")), F.lit("unknown")))
        .when(given("photo"), "photo")
    )
    for field in ("location", "contact", "poll"):
        kind = kind.when(given({"location": "location_information", "contact": "contact_information"}.get(field, field)), field)
    return kind.when(given("dice"), "dice").when(c("mime_type").startswith("application/"), "document").when(c("text").isNotNull() | c("text_entities").isNotNull(), "text").otherwise("unknown")


# Attributes of a live message and the kinds they stand for, in the order in which they decide.
LIVE_KINDS = [
    ("forward_origin", "forward"), ("photo", "photo"), ("video", "video"), ("voice", "voice"), ("audio", "audio"), ("document", "document"),
    ("sticker", "sticker"), ("animation", "animation"), ("video_note", "video_note"), ("location", "location"), ("contact", "contact"),
    ("poll", "poll"), ("dice", "dice"), ("new_chat_members", "service"), ("left_chat_member", "service"), ("pinned_message", "service"),
    ("text", "text"),
]


def live_kind(message: Column) -> Column:
    """Kind of a live message from its JSON: the first attribute that isn't null."""
    at = lambda name: F.get_json_object(message, f"$.{name}")
    return F.coalesce(*[F.when(at(name).isNotNull(), kind) for name, kind in LIVE_KINDS], F.lit("unknown"))


def text_and_caption(kind: Column, text: Column, entities_text: Column | None = None) -> Column:
    """Struct of text and caption of an exported message: the text, or what its entities say if it is empty; media have it as
    their caption. Empty is null."""
    some = lambda x: F.when(x != "", x)
    whole = some(text) if entities_text is None else F.coalesce(some(text), some(entities_text))
    media = kind.isin(*MEDIA_KINDS)
    return F.struct(F.when(~media, whole).alias("text"), F.when(media, whole).alias("caption"))


def export_user_id(from_id: Column) -> Column:
    """user<N> gives N, channel<N> gives -1, all else, and numbers that no id reaches, null."""
    digits = F.regexp_extract(from_id, r"^(?:user|channel)(\d+)$", 1)
    return F.when(digits == "", None).when(from_id.startswith("channel"), F.lit(-1)).otherwise(digits.try_cast("long"))


def utc_time(iso: Column) -> Column:
    """ISO time; without a zone it is UTC, whatever the session's zone. Null if it doesn't parse."""
    zoned = F.regexp_like(iso, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    return F.try_to_timestamp(F.when(zoned, iso).otherwise(F.concat(iso, F.when(F.length(iso) == 10, "T00:00:00Z").otherwise("Z"))))


def export_time(unix: Column, iso: Column) -> Column:
    """Seconds as a string if they parse, else an ISO time (UTC if it names no zone), else null."""
    return F.coalesce(F.timestamp_micros((unix.try_cast("double") * 1_000_000).cast("long")), utc_time(iso))


def html_escape(text: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]
    for raw, escaped in pairs:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def display_name(first: Column, last: Column, username: Column) -> Column:
    """First name, and last name after it, else @username, else a dash; escaped for HTML."""
    some = lambda x: F.when(x != "", x)
    full = F.concat(some(first), F.coalesce(F.concat(F.lit(" "), some(last)), F.lit("")))
    return F.coalesce(html_escape(F.coalesce(full, F.concat(F.lit("@"), some(username)))), F.lit("—"))


def permalink(chat_id: Column, message_id: Column) -> Column:
    """Link to a message; the -100 prefix of long chat ids is left out."""
    return F.concat(F.lit("https://t.me/c/"), F.regexp_replace(chat_id.cast("string"), r"^-100", ""), F.lit("/"), message_id.cast("string"))


def highlight_html(snippet: Column) -> Column:
    """Everything escaped but quotes and <b> and </b>."""
    out = html_escape(snippet, quotes=False)
    for raw, escaped in (("&lt;b&gt;", "<b>"), ("&lt;/b&gt;", "</b>")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def row_hash(*cells: Column) -> Column:
    """SHA-256 of cells joined by |; a null cell counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), 256)


def _best_cover(events: Column, n_terms: Column, most: int) -> Column:
    """Of the shortest stretches that hold all terms the best one: a struct of long (more than most words), fewer (minus its hits; 0 if long),
    size and first; null if there is none. That of the least struct is the best.

    events: sorted array of structs (pos, term), one at a position, term from 0 to n_terms - 1. Two pointers run over the events: the
    last place of each term, and the event at hand; places carry their number, so a stretch's hits are a difference.
    """
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("n"))
    none = F.lit(None).cast("struct<long:boolean,fewer:int,size:int,first:int>")
    start = F.struct(F.array_repeat(nowhere, n_terms).alias("last"), F.lit(-1).alias("from"), F.lit(0).alias("n"), none.alias("best"))

    def step(state: Column, e: Column) -> Column:
        here = F.struct(e["pos"].cast("int").alias("pos"), state["n"].alias("n"))
        last = F.transform(state["last"], lambda v, i: F.when(i == e["term"], here).otherwise(v))

        def judged(last: Column) -> Column:
            begin = F.array_min(last)
            size = e["pos"].cast("int") - begin["pos"] + 1
            found = F.struct((size > most).alias("long"), F.when(size > most, 0).otherwise(begin["n"] - state["n"] - 1).alias("fewer"), size.alias("size"), begin["pos"].alias("first"))
            best = F.when(begin["pos"] > state["from"], F.least(F.coalesce(state["best"], found), found)).otherwise(state["best"])
            return F.struct(last.alias("last"), begin["pos"].alias("from"), (state["n"] + 1).alias("n"), best.alias("best"))

        return let(last, judged)

    return F.aggregate(events, start, step, lambda s: s["best"])


def cover_density(events: Column, n_terms: Column, weight: float = 0.1) -> Column:
    """Cover-density rank: for each shortest stretch that holds all terms, weight / (1 + words in it that are no term).

    events: sorted array of structs (pos, term), term from 0 to n_terms - 1: where a text has terms. Linear in the events.
    """
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("n"))
    start = F.struct(F.array_repeat(nowhere, n_terms).alias("last"), F.lit(-1).alias("from"), F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("rank"))

    def step(state: Column, e: Column) -> Column:
        here = F.struct(e["pos"].cast("int").alias("pos"), state["n"].alias("n"))
        last = F.transform(state["last"], lambda v, i: F.when(i == e["term"], here).otherwise(v))

        def judged(last: Column) -> Column:
            begin = F.array_min(last)
            # Of the words after the first, those that are no event.
            worth = F.lit(weight) / (1 + (e["pos"] - begin["pos"]) - (state["n"] - begin["n"]))
            return F.struct(last.alias("last"), begin["pos"].alias("from"), (state["n"] + 1).alias("n"), (state["rank"] + F.when(begin["pos"] > state["from"], worth).otherwise(0.0)).alias("rank"))

        return let(last, judged)

    return F.aggregate(events, start, step, lambda s: s["rank"])


def bare_word(word: Column) -> Column:
    """A word in lower case with nothing but letters and digits."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")


def headline(text: Column, terms: Column, max_words: int = 35, min_words: int = 10, short: int = 2, normal: Callable[[Column], Column] = bare_word) -> Column:
    """A piece of text with its terms in <b>.

    The piece grows from the best of the shortest stretches that hold all terms the text has: of those within max_words the one with most
    hits, then the shortest, then the first; if none is that short, the first max_words words of the shortest, then first. A
    stretch under min_words is continued to its right, then to its left. Words of at most short characters at either end that are no
    hits are cut, as long as min_words are left. Without a hit the piece is the text's first min_words words. normal: what
    is compared of a word. Linear in the words.
    """
    if max_words < 1 or not 0 < min_words <= max_words or short < 0:
        raise ValueError("max_words and min_words must be positive, min_words not above max_words, short not negative")

    def shown(words: Column, own: Column, here: Column, best: Column) -> Column:
        n = F.size(words)
        first = F.coalesce(best["first"], F.lit(0))
        length = F.least(F.coalesce(best["size"], F.lit(min_words)), F.lit(max_words))
        end = F.least(F.greatest(first + length, first + min_words), n)
        begin = F.greatest(F.least(first, end - min_words), F.lit(0))
        piece = F.slice(F.zip_with(words, own, lambda w, o: F.struct(w.alias("w"), o.alias("o"))), begin + 1, F.greatest(end - begin, F.lit(0)))
        hit = lambda x: F.array_contains(here, x["o"])

        def trimmed(piece: Column) -> Column:
            firm = F.filter(F.transform(piece, lambda x, i: F.when((F.length(x["w"]) > short) | hit(x), i)), lambda i: i.isNotNull())
            spare = F.greatest(F.size(piece) - min_words, F.lit(0))
            right = F.least(F.size(piece) - 1 - F.coalesce(F.array_max(firm), F.lit(-1)), spare)
            left = F.least(F.coalesce(F.array_min(firm), F.size(piece)), spare - right)
            return F.slice(piece, left + 1, F.greatest(F.size(piece) - left - right, F.lit(0)))

        return F.array_join(F.transform(let(piece, trimmed), lambda x: F.when(hit(x), F.concat(F.lit("<b>"), x["w"], F.lit("</b>"))).otherwise(x["w"])), " ")

    def with_terms(words: Column, own: Column, here: Column) -> Column:
        # Terms that the text doesn't have don't count, so numbers are dealt to those it has.
        at = F.filter(F.transform(own, lambda w, i: F.struct(i.alias("pos"), (F.array_position(here, w) - 1).cast("int").alias("term"))), lambda e: e["term"] >= 0)
        return let(_best_cover(at, F.size(here), max_words), lambda best: shown(words, own, here, best))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return let(words, lambda words: let(F.transform(words, normal), lambda own: let(F.array_intersect(terms, own), lambda here: with_terms(words, own, here))))


def intro_text(template: str, answers: list[Column]) -> Column:
    """template with {0}, {1}, ... replaced by the answers, escaped; a dash for what is missing."""
    out = F.lit(template)
    for i, a in enumerate(answers):
        shown = html_escape(F.trim(a))
        out = F.replace(out, F.lit(f"{{{i}}}"), F.when(F.coalesce(shown, F.lit("")) == "", "—").otherwise(shown))
    return out


def shown_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def iso_time(ts: Column) -> Column:
    """ISO time with its offset, as in JSON reports."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
