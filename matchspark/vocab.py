"""Vocabularies, thresholds, patterns and prices the jobs must agree on."""

# Freshness windows in days.
CANDIDATE_DAYS = 30
VACANCY_DAYS = 60

# Longest text kept, in characters.
TEXT_CAP = 200_000

# Ordered vocabularies (lowest rank first where order matters).
LANGUAGES = [
    "Inglese", "Italiano", "Spagnolo", "Francese", "Tedesco", "Portoghese",
    "Cinese", "Giapponese", "Coreano", "Russo", "Arabo", "Olandese", "Svedese",
    "Polacco", "Turco", "Urdu", "Bangalese",
]
REGIONS = [
    "Abruzzo", "Basilicata", "Calabria", "Campania", "Emilia-Romagna",
    "Friuli-Venezia Giulia", "Lazio", "Liguria", "Lombardia", "Marche", "Molise",
    "Piemonte", "Puglia", "Sardegna", "Sicilia", "Toscana", "Trentino-Alto Adige",
    "Umbria", "Valle d Aosta", "Veneto",
]
EDUCATION_LEVELS = [
    "Diploma scuola media", "Diploma scuola superiore", "Laurea triennale",
    "Laurea specialistica", "Dottorato/Master",
]
MOBILITY_LEVELS = ["Locale", "Regionale", "Nazionale", "Internazionale"]
SHIFTS = ["Mattina", "Pomeriggio", "Notte", "Fine Settimana"]
WEEKEND_SHIFT = "Fine Settimana"
PART_TIME_PERCENTS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
SERVED_PROVINCES = [
    "Foggia", "Bari", "Andria", "Trani", "BAT", "Barletta-Andria-Trani", "Taranto",
    "Lecce", "Brindisi", "Bologna", "Ferrara", "Forlì-Cesena", "Modena", "Parma",
    "Piacenza", "Ravenna", "Reggio Emilia", "Rimini",
]

# Column groups.
CANDIDATE_FEATURES = [
    "age", "date_of_birth", "location", "region", "country", "zip_code", "last_job",
    "second_last_job", "third_last_job", "skills", "soft_skills", "languages",
    "certifications", "education",
]
VACANCY_FEATURES = [
    "country", "turno_preferenza", "parttime_preferenza_perc", "skills",
    "languages", "education", "certifications",
]
CANDIDATE_VECTORS = [
    "skills_emb", "last_job_emb", "second_last_job_emb", "third_last_job_emb",
]
VACANCY_VECTORS = ["jobtitle_emb", "skills_emb"]
GEO_COLUMNS = ["latitude", "longitude", "province_ext", "distance_km"]
SEARCH_COLUMNS = ["last_job", "second_last_job", "third_last_job", "skills"]
SEARCH_ATTRIBUTES = ["age", "province_ext"]
SEARCH_OUTPUT = ["candidateid", "age", "location", "province_ext", *SEARCH_COLUMNS]

# Placeholders.
NO_TEXT = "Non disponibile"
FAR_AWAY_KM = 999999
JUNK_WORDS = ["null", "none", "nan"]
CHAT_QUESTION = "Sei disponibile a lavorare nel fine settimana?"
RAW_HEADER = "Description"
CHAT_HEADER = "Chatwa"
PROFILE_URL = "https://example.invalid/candidate?id="

# Score weights (last, second last, third last job, skills).
SCORE_WEIGHTS = (50.0, 25.0, 15.0, 5.0)
OLDER_SCORE_WEIGHTS = (40.0, 30.0, 20.0, 5.0)
MATCH_LIMIT = 100
SEARCH_LIMIT = 5

# Credits per million tokens (model, input, output).
MODEL_PRICES = [
    ("llama3.1-8b", 0.11, 0.11),
    ("llama4-maverick", 0.12, 0.49),
    ("openai-gpt-5", 0.69, 5.5),
    ("openai-gpt-5-mini", 0.14, 1.1),
]

# Format patterns.
ZIP_PATTERN = r"^[0-9]{5}$"
COORD_PATTERN = r"^-?\d{1,3}\.\d{1,10}$"
LATITUDE_PATTERN = r"^[-+]?([0-8]?\d(\.\d+)?|90(\.0+)?)$"
LONGITUDE_PATTERN = r"^[-+]?((1[0-7]\d|0?\d{1,2})(\.\d+)?|180(\.0+)?)$"
BIRTH_PATTERN = (
    r"^(19|20)[0-9]{2}-("
    r"(01|03|05|07|08|10|12)-(0[1-9]|[12][0-9]|3[01])"
    r"|(04|06|09|11)-(0[1-9]|[12][0-9]|30)"
    r"|02-(0[1-9]|1[0-9]|2[0-8]))$"
)
