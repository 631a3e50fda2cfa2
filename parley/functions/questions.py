"""Whether a final utterance is a question, as Column expressions over its tokens.

Ten rules are tried in order; the first that holds gives the reason. All lists are fixed values:
they decide which recorded utterances count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import KAZAKH, folded, tokens

# Words and phrases of the ten rules.
PHRASES = ["можно ли", "могли бы", "не могли бы", "можете ли", "не подскажете", "как вы думаете", "как вы считаете", "что вы думаете", "что думаете", "что скажете", "ваше мнение", "как считаете", "а вы", "а у вас", "а вам", "а ты", "а у тебя", "или нет", "да или нет", "согласны ли", "вы согласны", "не так ли", "не правда ли", "как насчет", "сіз ше", "сіздер ше", "сендер ше", "сен ше", "не үшін", "не дейсіз", "қалай ойлайсыз"]
REQUESTS = ["расскажите", "расскажи", "объясните", "объясни", "поясните", "поясни", "уточните", "подскажите", "подскажи", "скажите", "скажи", "опишите", "прокомментируйте", "покажите", "поделитесь", "назовите", "перечислите", "напомните", "айтыңызшы", "айтыңыз", "айтшы", "айтып", "түсіндіріңізші", "түсіндіріңіз", "түсіндірші", "түсіндіріп", "көрсетіңізші", "көрсетіңіз"]
LI_BLOCKERS = ["вряд", "навряд", "едва", "то"]
PARTICLES = ["ма", "ме", "ба", "бе", "па", "пе"]
HOSTS = ["бар", "керек", "болады", "бола", "рас", "дайынсыз", "келесіз", "білесіз", "мүмкін", "жоқ"]
GLUED = r"^(?:бар|жоқ|бола|болады|болды|білесіз|келесіз|келісесіз|дайынсыз|түсінікті|рас|дұрыс|мүмкін|керек)(?:ма|ме|ба|бе|па|пе)$|(?:сыз|сіз|сыздар|сіздер)(?:ба|бе|па|пе)$"
KAZAKH_WH = ["қалай", "қалайша", "неге", "неліктен", "несіне", "қашан", "қайда", "қайдан", "қайсы", "қайсысы", "кім", "кімге", "кімнің", "кімді", "кіммен", "қанша", "қандай", "неше", "нешеу", "нешінші", "нені", "неден", "немен"]
VERB_ENDS = "(сыз|сіз|сыздар|сіздер|мыз|міз|ймыз|йміз|сың|сің)$"
STRONG_WH = ["почему", "зачем", "отчего", "сколько", "насколько", "куда", "откуда", "какой", "какая", "какое", "какие", "каким", "каких", "какую", "какого", "какому", "какими", "каков", "какова", "каковы", "чей", "чья", "чье", "чьи"]
AMBIGUOUS_WH = ["как", "что", "чего", "чем", "когда", "где", "кто", "кого", "кому", "кем"]
BLOCKED_AFTER = ["так", "потому", "то", "чтобы", "также", "тогда", "после", "пока", "вот", "знаю", "знаем", "понятно", "ясно", "неважно", "независимо", "сказал", "сказали", "объяснил", "понимаю", "поэтому"]
BLOCKED_BEFORE = ["то", "нибудь", "либо", "бы", "раз", "только", "минимум", "максимум", "обычно", "всегда", "правило", "будто", "ни", "касается", "угодно", "попало"]
FILLERS = ["а", "и", "ну", "так", "вот", "слушайте", "коллеги", "ал", "енді", "иә", "жарайды", "ок", "окей", "хорошо", "понятно", "ясно", "да", "ладно", "тогда", "кстати", "еще", "ещё"]
PRONOUNS = ["я", "мы", "он", "она", "они", "оно"]
ADDRESSES = ["вы", "вас", "вам", "вами", "ваш", "ваша", "ваше", "ваши", "вашей", "вашего", "вашу", "вашим", "ты", "тебя", "тебе", "твой", "твоя", "твои", "сіз", "сізге", "сізде", "сіздің", "сізді", "сізбен", "сіздер", "сендер", "сен", "саған", "сенде", "сенің"]
GREETINGS = ["сәлеметсіз бе", "сәлеметсіздер ме", "сәлеметсіздер бе", "амансыз ба", "амансыздар ма", "қалыңыз қалай", "қалың қалай", "как дела", "как ваши дела"]
ANNOUNCED = ["вопрос", "вопросик", "сұрақ"]


def without_greetings(words: Column) -> Column:
    """The tokens without greetings that are questions by their words."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for g in GREETINGS:
        joined = F.replace(joined, F.lit(f" {g} "), F.lit(" "))
    return F.filter(F.split(joined, " "), lambda w: w != "")


def question_reason(text: Column) -> Column:
    """The rule by which a text is a question, null if it is none."""
    words = without_greetings(tokens(text))
    n = F.size(words)
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    kazakh = F.exists(words, lambda w: w.rlike(f"[{KAZAKH}]"))

    def first(name: str, holds, since: Column | int = 0) -> Column:
        """The rule's name and the first token that it holds for."""
        hit = F.filter(places, lambda i: (i >= since) & holds(i))
        return F.when(F.size(hit) > 0, F.concat(F.lit(f"{name}:"), at(F.get(hit, F.lit(0)))))

    def unblocked(i: Column) -> Column:
        return ~(at(i + 1).isin(BLOCKED_BEFORE) | ((i > 0) & at(i - 1).isin(BLOCKED_AFTER)))

    def what(i: Column) -> Column:
        following = at(i + 1)
        return (at(i) == "не") & kazakh & ((i == n - 1) | following.rlike(f"[{KAZAKH}]") | following.rlike(VERB_ENDS) | (following == "бар"))

    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrase = F.coalesce(*[F.when(F.contains(joined, F.lit(f" {p} ")), f"phrase:{p}") for p in PHRASES])
    leading = F.size(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: (i < n - 1) & F.forall(F.slice(words, 1, i + 1), lambda w: w.isin(FILLERS))))
    addressed = F.exists(words, lambda w: w.isin(ADDRESSES))
    reason = F.coalesce(
        phrase,
        first("request", lambda i: at(i).isin(REQUESTS)),
        first("particle", lambda i: (at(i) == "ли") & ~at(i - 1).isin(LI_BLOCKERS), 1),
        first("particle", lambda i: at(i).isin(PARTICLES) & (kazakh | (i == n - 1) | at(i - 1).isin(HOSTS) | at(i + 1).isin("екен", "әлде")), 1),
        first("glued", lambda i: at(i).rlike(GLUED)),
        F.when(kazakh & (n > 1) & (at(n - 1) == "ше"), "particle:ше"),
        first("wh-kk", lambda i: at(i).isin(KAZAKH_WH) | what(i)),
        first("wh", lambda i: at(i).isin(STRONG_WH) & unblocked(i)),
        first("wh-start", lambda i: (i < leading + 2) & at(i).isin(AMBIGUOUS_WH) & unblocked(i) & ~(at(i + 1).isin(PRONOUNS) & (n >= 7) & ~addressed), leading),
        F.when(F.exists(words, lambda w: w.isin(ANNOUNCED)), first("wh-announced", lambda i: at(i).isin(AMBIGUOUS_WH) & unblocked(i))),
    )
    return F.when(n > 0, reason)


# Case endings that a spoken name may carry, by kind of stem.
NAME_ENDS = ["га", "ге", "ка", "ке", "на", "не", "нын", "нин", "дын", "дин", "тын", "тин", "ны", "ни", "ды", "ди", "ты", "ти", "н", "да", "де", "та", "те", "нда", "нде", "дан", "ден", "тан", "тен", "нан", "нен", "мен", "бен", "пен", "ша", "ше", "дай", "дей", "тай", "тей", "лар", "лер", "дар", "дер", "тар", "тер", "жан", "а", "у", "ом", "е", "ым", "ой", "ы", "ю", "ем", "ей", "я"]
A_STEM_ENDS = ["ы", "и", "е", "у", "ю", "ой", "ей", "ою", "ею"]
SOFT_STEM_ENDS = ["я", "ю", "ем", "е", "и"]


def spells_name(token: Column, name: Column) -> Column:
    """Whether a folded token is a folded name word, perhaps with a case ending."""
    stem, last = F.substr(name, F.lit(1), F.length(name) - 1), F.right(name, F.lit(1))
    rest = lambda base: F.substr(token, F.length(base) + 1)
    inflected = (
        (F.startswith(token, name) & rest(name).isin(NAME_ENDS))
        | (last.isin("а", "я") & F.startswith(token, stem) & rest(stem).isin(A_STEM_ENDS))
        | (last.isin("й", "ь") & F.startswith(token, stem) & rest(stem).isin(SOFT_STEM_ENDS))
    )
    return (token == name) | ((F.length(name) >= 3) & inflected)


def name_place(words: Column, name_words: Column) -> Column:
    """The first token (from 0) where the folded words of a name stand in a row; null if nowhere."""
    n = F.size(words) - F.size(name_words)
    hits = F.filter(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.forall(F.zip_with(F.slice(words, i + 1, F.size(name_words)), name_words, spells_name), lambda x: x))
    return F.get(hits, F.lit(0))


# Latin pairs and letters and their Cyrillic spelling.
LATIN_PAIRS = {"sh": "ш", "ch": "ч", "zh": "ж", "kh": "х", "ts": "ц", "ya": "я", "yu": "ю", "yo": "е"}
LATIN_LETTERS = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л", "m": "м",
    "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}


def name_hit(text: Column, names: Column) -> Column:
    """name, place and vocative of the first of some names in a text (ties: the earlier name), null if none is in it.

    A Latin name is looked for in Cyrillic, too. It is vocative at the text's end, or within two words of
    its beginning, leading fillers aside.
    """
    words = F.filter(F.split(folded(text), "[^a-zа-я0-9]+"), lambda w: w != "")
    n = F.size(words)
    leading = F.size(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: (i < n - 1) & F.forall(F.slice(words, 1, i + 1), lambda w: w.isin(FILLERS))))

    def hit(name: Column, k: Column) -> Column:
        own = F.filter(F.split(folded(name), "[^a-zа-я0-9]+"), lambda w: w != "")
        spelled = F.transform(own, lambda w: F.when(w.rlike("[a-z]"), cyrillic(w)).otherwise(w))
        place = F.least(name_place(words, own), name_place(words, spelled))
        vocative = (place <= leading + 1) | (place + F.size(own) == n)
        return F.when(F.size(own) > 0, F.struct(place.alias("place"), k.alias("k"), name.alias("name"), vocative.alias("vocative")))

    found = F.filter(F.transform(names, hit), lambda h: h["place"].isNotNull())
    first = F.array_min(found)
    return F.when(first.isNotNull(), F.struct(first["name"].alias("name"), first["place"].alias("place"), first["vocative"].alias("vocative")))


def cyrillic(word: Column) -> Column:
    """A Latin spelling as the recognizer writes it, from left to right: pairs before letters, i after a vowel as й."""
    w = F.lower(word)
    pairs, letters = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (LATIN_PAIRS, LATIN_LETTERS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"))

    def step(state: Column, i: Column) -> Column:
        one, two, last = F.substr(w, i + 1, F.lit(1)), F.substr(w, i + 1, F.lit(2)), F.substr(w, i, F.lit(1))
        pair = F.try_element_at(pairs, two)
        letter = F.when((one == "i") & (i > 0) & last.isin("a", "e", "o", "u"), "й").otherwise(F.coalesce(F.try_element_at(letters, one), one))
        taken = F.struct(F.concat(state["out"], F.coalesce(pair, letter)).alias("out"), (i + F.when(pair.isNotNull(), 2).otherwise(1)).alias("next"))
        return F.when(i < state["next"], state).otherwise(taken)

    places = F.when(F.length(w) > 0, F.sequence(F.lit(0), F.length(w) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["out"])
