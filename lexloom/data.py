"""Word lists and limits that results depend on.  Fixed values, in their natural order."""

from __future__ import annotations

# The cases that prepositions govern.
GOVERNS = {
    "в": "accs loct",
    "во": "accs loct",
    "на": "accs loct",
    "о": "loct accs",
    "об": "loct accs",
    "обо": "loct accs",
    "при": "loct",
    "по": "datv loct accs",
    "с": "ablt gent",
    "со": "ablt gent",
    "к": "datv",
    "ко": "datv",
    "благодаря": "datv",
    "согласно": "datv",
    "вопреки": "datv",
    "навстречу": "datv",
    "подобно": "datv",
    "за": "accs ablt",
    "под": "accs ablt",
    "подо": "accs ablt",
    "над": "ablt",
    "перед": "ablt",
    "передо": "ablt",
    "между": "ablt gent",
    "через": "accs",
    "сквозь": "accs",
    "про": "accs",
    "у": "gent",
    "из": "gent",
    "изо": "gent",
    "от": "gent",
    "ото": "gent",
    "до": "gent",
    "без": "gent",
    "безо": "gent",
    "для": "gent",
    "из-за": "gent",
    "из-под": "gent",
    "около": "gent",
    "возле": "gent",
    "вокруг": "gent",
    "после": "gent",
    "кроме": "gent",
    "среди": "gent",
    "вместо": "gent",
    "мимо": "gent",
    "против": "gent",
    "ради": "gent",
    "сверх": "gent",
    "ввиду": "gent",
    "вследствие": "gent",
    "насчёт": "gent",
    "насчет": "gent",
    "позади": "gent",
    "внутри": "gent",
    "вне": "gent",
    "близ": "gent",
    "вдоль": "gent",
    "напротив": "gent",
    "прежде": "gent",
    "посреди": "gent",
    "относительно": "gent",
    "накануне": "gent",
    "помимо": "gent",
    "внутрь": "gent",
    "поверх": "gent",
}

# Personal pronouns as subjects.
PRONOUNS = {
    "я": "1per sing",
    "ты": "2per sing",
    "он": "3per sing masc",
    "она": "3per sing femn",
    "оно": "3per sing neut",
    "мы": "1per plur",
    "вы": "2per plur",
    "они": "3per plur",
    "кто": "3per sing",
    "никто": "3per sing",
}

# Words and phrases that the rules for marks speak of.
SUBORDINATING = "что чтобы если когда потому так как хотя пока раз будто словно ибо ежели дабы поскольку чем лишь едва".split()
PARENTHETICAL = (
    "конечно наверное например кстати впрочем во-первых во-вторых в-третьих кажется пожалуй видимо разумеется по-моему по-видимому "
    "вероятно очевидно безусловно бесспорно несомненно право правда итак следовательно напротив наоборот словом значит стало может казалось "
    "говорят признаться по-твоему по-вашему по-нашему"
).split()
APART_MORE = "ну да нет ах ох эх ой вот наконец главное действительно бывает ну-ка ведь впрочем".split()
INTERJECTIONS = "ах ох эх ой ай ух увы о ого угу ага эй фу ура хм блин ба эге ну-ну".split()
ASIDE_FIRST = (
    "кстати конечно наверное например впрочем во-первых во-вторых в-третьих кажется пожалуй видимо разумеется по-моему по-видимому "
    "вероятно очевидно безусловно несомненно итак следовательно словом по-твоему по-вашему по-нашему"
).split()
GERUND_IDIOMS = [
    ("сложа", "руки"), ("сломя", "голову"), ("покладая", "рук"), ("спустя", "рукава"), ("засучив", "рукава"),
    ("затаив", "дыхание"), ("разинув", "рот"), ("скрепя", "сердце"), ("очертя", "голову"), ("переводя", "дыхания"),
    ("смыкая", "глаз"), ("высунув", "язык"), ("сломя", "шею"), ("навострив", "уши"), ("опустив", "руки"),
]
SAYING = (
    "сказа говор сообщ заяв отмет подчеркн добав пояснил уточн рассказ признал написал спрос ответ отвеча продолж прибав повтор "
    "крикн закрич прошепт шепн проговор восклик думал подумал решил заметил возраз объясн указ призна констатир передает пишет "
    "считает полагает уверен"
).split()
ADVERSATIVE = "а но однако зато да же".split()
JOINING = "и или либо ни да".split()
PAREN_PHRASES = [
    "в частности", "кроме того", "к тому же", "таким образом", "с одной стороны", "с другой стороны", "в первую очередь", "в свою очередь",
    "по крайней мере", "на самом деле", "по сути", "как правило", "как известно", "как оказалось", "как выяснилось", "как сообщается",
    "как говорится", "к сожалению", "к счастью", "к слову", "по-видимому", "без сомнения", "конечно же", "по его словам", "по ее словам",
    "по их словам", "по моему мнению", "по словам", "по данным", "по мнению", "по информации", "по сообщению", "по оценкам",
    "по прогнозам", "по подсчетам", "по сведениям", "по версии",
]
ASIDE_PHRASES = [
    "честно говоря", "по правде говоря", "откровенно говоря", "собственно говоря", "иначе говоря", "короче говоря", "мягко говоря",
    "грубо говоря", "строго говоря", "вообще говоря", "попросту говоря", "по слухам", "как всегда", "как обычно", "судя по всему",
    "между прочим", "скорее всего", "на мой взгляд", "на твой взгляд", "на наш взгляд", "другими словами", "иными словами", "так сказать",
    "по всей видимости", "по всей вероятности", "как ни странно", "кроме шуток", "само собой разумеется", "к несчастью", "без всякого сомнения",
]
QUESTION = "ли разве неужели неужто что-ли".split()
ASKING = (
    "кто что где куда откуда когда почему зачем отчего как сколько насколько какой какая какое какие каков какова чей чья чье чьи "
    "каким какую какого какому каком каких кого кому кем ком чего чему чем чего-нибудь"
).split()

# By strength of correction, the most it may cost a letter, its lead over the next, and the margin over a known word.
STRENGTHS = {
    "careful": (0.8, 1.5, 2.5),
    "normal": (1.3, 0.8, 1.5),
    "bold": (1.8, 0.4, 0.8),
    "always": (float("inf"), 0.0, 0.8),
}
# What counts as one slip, the slip allowed to a known word, and that of another form which the grammar asks for, by how much; a space too early.
ONE_SLIP, KNOWN_SLIP, GRAMMAR_SLIP, GRAMMAR_GAP, SPACE_EARLY = 3.5, 1.6, 3.5, 2.5, 2.5
# Letters typed before a space may finish a word, and letters it may add.
COMPLETE_FROM, COMPLETE_ON_SPACE = 4, 2
# Log odds from which a comma is put by itself, and the prices and margin of two words for one.
COMMA_SURE, MISSING_SPACE, SPACE_AS_LETTER, SPLIT_MARGIN = 2.2, 3.0, 2.0, 1.0
# Words of one letter by language, and the letters above the space on both layouts.
ONE_LETTER_WORDS = {"ru": "вксиаоуяai", "en": "вксиаоуяai", "de": "", "fr": "aày", "es": "aeouy", "pt": "aeoàé"}
ABOVE_SPACE = "cvbnmсмить"
