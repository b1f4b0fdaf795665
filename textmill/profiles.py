"""The words, patterns and prompts that results must agree on."""

from dataclasses import dataclass

# ---- fixed values -------------------------------------------------------------------------
MONTHS = ["қаңтар", "ақпан", "наурыз", "сәуір", "мамыр", "маусым", "шілде", "тамыз", "қыркүйек", "қазан", "қараша", "желтоқсан"]
UNITS = {"трлн": 1e12, "млрд": 1e9, "млн": 1e6, "мың": 1e3}
NUMBER_WORDS = {"млрд": 1_000_000_000, "трлн": 1_000_000_000_000, "млн": 1_000_000, "мың": 1_000, "жүз": 100}
SUFFIXES = ["ның", "нің", "дың", "дің", "тың", "тің", "ды", "ді", "ны", "ні", "ға", "ге", "қа", "ке", "да", "де", "та", "те", "нан", "нен", "дан", "ден"]
STOP_PREDICATES = ["болу", "бар", "жоқ", "деу", "ету", "келу", "кету", "be", "have", "say", "go", "come"]
CANONICAL_PREDICATES = [
    "өсу", "артыу", "жоғарылау", "ұлғайу", "күшею", "азаю", "төмендеу", "қысқару", "кему", "жету", "қол жеткізу", "орындау",
    "жариялау", "хабарлау", "мәлімдеу", "айту", "бөлу", "инвестициялау", "қаржыландыру", "өндіру", "шығару", "жасау",
    "асыу", "аспау", "тең болу", "increase", "decrease", "reach", "allocate", "produce", "announce", "invest", "achieve", "exceed",
]
STATIC_COLUMNS = ["Тақырып", "Оқиға", "Көрсеткіш", "Кезең", "Қосымша мәлімет"]
GROWTH = ["өсу", "азаю", "жету", "деңгей", "increase", "decrease", "reach"]
TIME = ["жыл", "тоқсан", "ай", "кезең", "year", "quarter", "period"]
ANNOUNCE = ["жариялау", "мәлімдеу", "announce"]
SUBJECT_COLUMN, DEFAULT_PREDICATE, NO_TABLE = "Субъект", "мәлімет", "_Мәтіннен кесте жасауға болмады._"
MOCK_TABLE = "| Тақырып | Мәлімет |\n|---------|----------|\n| Мәтін | - |"
BACK_VOWELS, FRONT_VOWELS = "аоұу", "әөүі"
INDICATIVE = ["ды", "ді", "ты", "ті", "ады", "еді", "йды", "йді", "жатыр", "тұр", "отыр"]
LATIN = "AaÁáBbDdEeFfGgǴǵHhIiÏïJjKkQqLlMmNnŃńOoÓóPpRrSsTtUuÚúÜüVvYyZz"
CYRILLIC = "АаӘәБбДдЕеФфГгҒғХхІіИиЖжКкҚқЛлМмНнҢңОоӨөПпРрСсТтУуҰұҮүВвЙйЗз"
ABBREVIATIONS = ["б.з.б", "б.з", "т.б", "т.д", "млн", "млрд", "км", "кг", "мың", "жыл", "ж", "қ", "б", "с", "мин", "сек", "га"]
ENTITY_PATTERNS = {
    "ORG": r"\b(?:ҚазМұнайГаз|Самрұқ-Қазына|Байтерек|КазАтомПром|ҚТЖ|«[А-ЯҒҚҢҮҰӨӘІa-zA-Z][^»]{2,}»|[А-ЯҒҚҢҮҰӨӘІa-zA-Z][а-яғқңүұөәі]+\s+(?:АҚ|ЖАҚ|ЖШС|ТОО|Corp|LLC))\b",
    "PERSON": r"\b[А-ЯҒҚҢҮҰӨӘІа-яғқңүұөәі]+\s+[А-ЯҒҚҢҮҰӨӘІ][а-яғқңүұөәі]+(?:ұлы|қызы)?\b",
    "QUANTITY": r"(?i)\b\d[\d\s]*(?:[,\.]\d+)?\s*(?:млрд|млн|трлн|мың|%|пайыз|теңге|долл|евро|т\.б\.)\b",
    "DATE": r"(?i)\b(?:20\d{2}|19\d{2})(?:\s+жыл(?:ы|дың|да|дан)?)?|\b(?:қаңтар|ақпан|наурыз|сәуір|мамыр|маусым|шілде|тамыз|қыркүйек|қазан|қараша|желтоқсан)(?:\s+20\d{2})?",
    "LOC": r"\b(?:Алматы|Астана|Шымкент|Қарағанды|Атырау|Ақтөбе|Павлодар|Семей|Өскемен|Тараз|Қостанай|Орал|Қазақстан|Ресей|Қытай|АҚШ|ЕО|ТМД)\b",
}
SYSTEM_PROMPTS = {
    "static": "Сіз деректерді журналистика саласының сарапшысысыз. Берілген мәтіннен кесте жасаңыз. Кесте міндетті түрде мына бағандардан тұруы керек: Тақырып | Оқиға | Көрсеткіш | Кезең | Қосымша мәлімет. Тек нақты фактілерді жазыңыз. Мәліметі жоқ ұяшықтарға '-' қойыңыз. Кестені Markdown форматында шығарыңыз.",
    "dynamic": "Сіз деректерді журналистика саласының сарапшысысыз. Берілген мәтіннің мазмұнына сай оңтайлы кесте бағандарын өзіңіз анықтаңыз. 2-8 баған таңдаңыз, баған атауларын мәтіннің семантикасынан шығарыңыз. Тек нақты фактілерді жазыңыз (галлюцинация болмасын). Кестені Markdown форматында шығарыңыз. Бос ұяшықтарға '-' қойыңыз.",
}
INSIGHT_PROMPTS = {
    "static": """Сіз Қазақстан журналистикасы саласының сарапшысысыз.
Берілген мәтіннен кесте жасаңыз. Кесте міндетті түрде мына бағандардан тұруы керек:
Тақырып | Оқиға | Көрсеткіш | Кезең | Қосымша мәлімет

Ережелер:
1. Тек мәтінде нақты айтылған фактілерді жазыңыз
2. Мәліметі жоқ ұяшықтарға "-" белгісін қойыңыз
3. Кестені Markdown форматында (pipe-delimited) шығарыңыз
4. Тақырыптар: Энергетика, Ауылшаруашылық, Цифрлық трансформация, т.б.""",
    "dynamic": """Сіз деректерді журналистика саласының сарапшысысыз.
Берілген мәтіннің мазмұнына сай оңтайлы кесте бағандарын өзіңіз анықтаңыз.

Нұсқаулар:
1. Мәтіннің мазмұнына қарай 2-8 баған таңдаңыз
2. Баған атауларын мәтіннің семантикасынан шығарыңыз
3. Тек нақты фактілерді жазыңыз (галлюцинация болмасын)
4. Кестені Markdown форматында шығарыңыз
5. Бос ұяшықтарға "-" қойыңыз""",
}
STEPS_PROMPT = """Мына мәтінді талдап, кесте жасаңыз:

{text}

Қадамдар:
1. Негізгі тақырыпты анықтаңыз
2. Барлық сандық деректерді тізімдеңіз
3. Әрбір деректі бастапқы сөйлемге байланыстырыңыз
4. Кестені жасаңыз"""
JUDGE_SYSTEM_PROMPT = """You are an expert evaluator for data journalism tasks. 
Compare the generated table to the reference table and source text.
Rate each dimension on a 0 to 1 scale (float, two decimal places).

Dimensions:
1) coverage: Are all key facts and numbers from the source text present in the generated table?
2) accuracy: Are all values factually correct? Penalize hallucinations heavily.
3) compression: Is the table concise? Penalize redundant or duplicate rows.
4) structure: Are columns consistent, headers meaningful, cell types homogeneous?
5) journalistic_value: Could a professional journalist use this table directly for reporting?

Return ONLY a JSON object with no additional text:
{"coverage": 0.85, "accuracy": 0.92, "compression": 0.97, "structure": 0.98, "journalistic_value": 0.90}"""
JUDGE_USER_PROMPT = """SOURCE TEXT:
{source_text}

REFERENCE TABLE:
{reference_table}

GENERATED TABLE:
{generated_table}

Evaluate the generated table on all 5 dimensions."""
JUDGE_SOURCE_CHARS = 1500
ANCHOR = r"\d+[,.]?\d*\s*%|(?iu:\d[\d\s]*(?:млрд|млн|мың|трлн))|\d{4}\s*ж|(?iu:" + "|".join(MONTHS) + r")|\d+\.\d+|(?U:\b)\d{1,3}(?:\s\d{3})+(?U:\b)"
NUMBER = r"(?iu)([+-])?(\d[\d\s]*)(?:[,.](\d+))?\s*(трлн|млрд|млн|мың|пайыз|%)?"
USER_PROMPT = "Мына мәтіннен кесте жасаңыз:\n\n{text}"
JUDGE_KEYS = ["coverage", "accuracy", "compression", "structure", "journalistic_value"]
# ---- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """What may begin a sentence, as a regular-expression class, and the least sentence length."""

    name: str
    begins: str
    min_chars: int = 0


KAZAKH = Profile("kazakh", r"[\u0400-\u04FF]")
MULTILINGUAL = Profile("multilingual", r"[\p{L}\p{N}]")
EXTENDED = Profile("extended", r"[\u0400-\u04FFa-zA-Z0-9]", 11)
