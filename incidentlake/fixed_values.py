"""Fixed values.

Word lists, lookup tables, headers and constants that define the results. They are
data, not logic: any change here changes what the queries return.
"""

# ---- enums ------------------------------------------------------------------
SEVERITIES = ("low", "medium", "high", "critical")
METHODS = ("phishing", "brute_force", "malware", "credential_stuffing", "ransomware", "sql_injection")
TARGETS = ("crm", "web_portal", "db_server", "file_server", "mail_gateway", "vpn_gateway", "workstation")
SEASONS = ("winter", "spring", "summer", "autumn")
TIMES_OF_DAY = ("night", "morning", "afternoon", "evening")
UNKNOWN = "Неизвестно"
DEFAULT_METHOD = "malware"
DEFAULT_TARGET = "workstation"
ARCHIVED_STATUS = "Архивная"

# ---- classifier tokens, in order of precedence -------------------------------
METHOD_TOKENS = (
    ("ransomware", ("шифров", "вымогат", "ransomware")),
    ("sql_injection", ("sql", "инъек", "входных данных", "запрос")),
    ("credential_stuffing", ("учётн", "учетн", "credential", "доступа к сетевым сервисам")),
    ("brute_force", ("подбор", "парол", "аутентификац", "авторизац", "логин")),
    ("phishing", ("фиш", "почтов", "почт", "спам")),
    ("malware", ("вредонос", "троян", "worm", "черв", "код")),
)
TARGET_TOKENS = (
    ("vpn_gateway", ("vpn", "удален", "сетевым сервисам")),
    ("mail_gateway", ("почт", "mail", "спам", "фиш")),
    ("crm", ("crm", "учётные данные пользователя", "учетные данные пользователя")),
    ("db_server", ("баз", "субд", "sql")),
    ("web_portal", ("веб", "web", "сайт", "портал", "браузер")),
    ("file_server", ("файл", "хранил", "общие папки")),
    ("workstation", ("bios", "uefi", "компьютер", "рабоч", "микропрограмм")),
)
LARGE_HOST_COUNT = 1000
SEVERE_METHODS = ("ransomware", "credential_stuffing")
EXTERNAL_TARGETS = ("vpn_gateway", "web_portal", "mail_gateway")
METHOD_BY_ASSET = {
    "crm": "phishing",
    "mail_gateway": "phishing",
    "vpn_gateway": "brute_force",
    "web_portal": "sql_injection",
    "db_server": "sql_injection",
    "file_server": "ransomware",
    "workstation": "malware",
}

# ---- source headers -----------------------------------------------------------
INCIDENT_HEADERS = {
    "Тип предприятия": "industry",
    "Код предприятия": "organization_code",
    "Количество хостов": "host_count",
    "Код реализованной угрозы": "threat_code",
    "Успех": "success",
    "Регион размещения предприятия": "region",
    "Дата инцидента": "incident_date",
    "Региональное время": "regional_time",
}
REGISTRY_HEADERS = {
    "Идентификатор УБИ": "threat_code",
    "Наименование УБИ": "name",
    "Описание": "description",
    "Источник угрозы (характеристика и потенциал нарушителя)": "source_characteristics",
    "Объект воздействия": "object_of_impact",
    "Нарушение конфиденциальности": "confidentiality_breach",
    "Нарушение целостности": "integrity_breach",
    "Нарушение доступности": "availability_breach",
    "Дата включения угрозы в БнД УБИ": "date_added",
    "Дата последнего изменения данных": "last_modified",
    "Статус угрозы": "status",
    "Замечания": "notes",
}
REGISTRY_REQUIRED_HEADERS = (
    "Идентификатор УБИ",
    "Наименование УБИ",
    "Источник угрозы (характеристика и потенциал нарушителя)",
    "Объект воздействия",
    "Нарушение конфиденциальности",
    "Нарушение целостности",
    "Нарушение доступности",
)
INCIDENT_HEADER_ROWS = 3
REGISTRY_HEADER_ROWS = 5
FILE_ENCODINGS = ("utf-8", "utf-8-sig", "cp1251", "latin1")
FILE_SEPARATORS = (";", ",", "\t")
PLACEHOLDER_DESCRIPTION = "Placeholder row created for referential integrity."

# ---- built-in incidents and registry (used when there is no table and no file) ---
BUILTIN_INCIDENTS = (
    # organization, industry, hosts, threat, success, region, date, time
    ("org-001", "telecom", 1200, 101, 1, "Moscow", "2026-01-10", "2026-01-10 09:00:00"),
    ("org-001", "telecom", 1200, 102, 1, "Moscow", "2026-01-11", "2026-01-11 21:00:00"),
    ("org-001", "telecom", 1200, 103, 0, "Moscow", "2026-03-05", "2026-03-05 06:30:00"),
    ("org-002", "finance", 640, 104, 1, "Saint Petersburg", "2026-07-20", "2026-07-20 14:15:00"),
    ("org-003", "retail", 220, 105, 0, "Novosibirsk", "2026-10-01", "2026-10-01 02:40:00"),
)
BUILTIN_REGISTRY = (
    # code, name, description, object of impact
    (101, "Компрометация VPN-доступа", "Подбор паролей и отсутствие MFA для удаленного доступа.", "VPN и сетевые сервисы"),
    (102, "Фишинговая рассылка", "Почтовые сообщения для кражи учетных данных пользователей.", "Почта и учетные данные пользователя"),
    (103, "Вредоносное ПО на рабочей станции", "Распространение вредоносного кода через пользовательские устройства.", "Рабочая станция"),
    (104, "SQL-инъекция веб-портала", "Атака через небезопасную обработку входных данных веб-приложения.", "Веб-портал и СУБД"),
    (105, "Шифровальщик файлового сервера", "Вредоносное шифрование общих папок и файловых хранилищ.", "Файловое хранилище"),
)
BUILTIN_STATUS = "Актуальна"

# ---- scoring ---------------------------------------------------------------------
SCORING_WEIGHTS = {
    "vulnerability_count_weight": 1.2,
    "attack_intensity_weight": 2.4,
    "asset_criticality_weight": 2.0,
    "risk_score_normalizer": 10.0,
    "confidence_base": 0.55,
    "confidence_multiplier": 0.4,
}
ASSET_CRITICALITY = {
    "crm": 1.6,
    "web_portal": 1.2,
    "db_server": 1.8,
    "file_server": 1.5,
    "mail_gateway": 1.3,
    "vpn_gateway": 1.7,
    "workstation": 0.9,
}
RISK_CAP = 0.99
CONFIDENCE_CAP = 0.98
MIN_INDUSTRY_ROWS = 3
MANY_PRIVILEGED_ACCOUNTS = 10
RISK_INDEX_WEIGHTS = {"low": 0.15, "medium": 0.35, "high": 0.65, "critical": 1.0}
RISK_INDEX_ELEVATED = 0.55
ALERT_ERROR_PERCENT = 60
ALERT_EXCEPTION_PERCENT = 70

# ---- rationale texts ---------------------------------------------------------------
RATIONALE_VULNERABILITIES = "Known vulnerability count considered: %d."
RATIONALE_INTENSITY = (
    "Attack intensity from history (region, season, hour; with enough data — industry %s): %.2f."
)
RATIONALE_CRITICALITY = "Asset criticality for %s: %.2f."
RATIONALE_EXTERNAL = "The asset has external exposure, which raises response priority."
RATIONALE_PRIVILEGED = "A large number of privileged accounts increases the attack surface."
RATIONALE_ML_ON = (
    "ML mode is active: target object and attack method come from the model; "
    "risk score and attack time window remain heuristic."
)
RATIONALE_ML_OFF = (
    "ML prediction was requested, but model output was unavailable. Heuristic target and method were used."
)

# ---- vulnerability mapping rules, in order -----------------------------------------
FALLBACK_THREAT = "TH-005"
MAPPING_RULES = (
    # tokens, threat, score, reason, recommendation method
    (
        ("cve", "парол", "password", "auth", "vpn", "login", "rdp", "ssh", "mfa", "credential"),
        "TH-003", 0.91,
        "Совпадение по признакам слабой аутентификации, удалённого доступа или подбора учётных данных.",
        "brute_force",
    ),
    (
        ("sql", "инъек", "input", "query", "web", "portal", "sqli", "database", "orm"),
        "TH-004", 0.88,
        "Описание уязвимости похоже на проблемы валидации ввода, web-форм или БД-запросов.",
        "sql_injection",
    ),
    (
        ("mail", "почт", "phish", "фиш", "attachment", "macro", "email", "smtp"),
        "TH-001", 0.84,
        "Есть связь с почтой, фишинговым сценарием, вложениями или компрометацией учётных данных через сообщения.",
        "phishing",
    ),
    (
        ("ransom", "шифров", "encrypt", "locker", "smb", "shared folder"),
        "TH-002", 0.86,
        "Уязвимость связана с распространением шифровальщика или компрометацией общих файловых ресурсов.",
        "ransomware",
    ),
    (
        ("trojan", "malware", "вредонос", "exe", "powershell", "macro", "loader"),
        "TH-005", 0.72,
        "Уязвимость похожа на сценарий доставки или запуска вредоносного ПО на конечной точке.",
        "malware",
    ),
    (
        ("*",),
        "TH-005", 0.62,
        "Использован fallback-matching по общему классу endpoint-рисков.",
        "malware",
    ),
)

# ---- threat catalog ------------------------------------------------------------------
CATALOG_SOURCE = "FSTEC threat catalog"
CATALOG_THREATS = (
    # id, name, description, category, severity, likely targets, common methods
    ("TH-001", "Компрометация CRM через фишинговую рассылку",
     "Получение доступа к CRM через кражу учетных данных сотрудников.",
     "credential_access", "high", ("crm", "mail_gateway"), ("phishing", "credential_stuffing")),
    ("TH-002", "Шифровальщик на файловом сервере",
     "Распространение ransomware внутри сегмента с общими папками.",
     "impact", "critical", ("file_server", "workstation"), ("ransomware", "malware")),
    ("TH-003", "Атака на VPN-шлюз через подбор пароля",
     "Попытка доступа через слабые пароли и отсутствие MFA.",
     "initial_access", "high", ("vpn_gateway",), ("brute_force", "credential_stuffing")),
    ("TH-004", "SQL-инъекция в веб-портал",
     "Эксплуатация входных форм без корректной валидации.",
     "application_attack", "medium", ("web_portal", "db_server"), ("sql_injection",)),
    ("TH-005", "Вредоносное ПО на рабочей станции",
     "Загрузка трояна пользователем с последующим lateral movement.",
     "execution", "medium", ("workstation", "file_server"), ("malware", "phishing")),
)
RECOMMENDATIONS = (
    # method, code, title, description, priority
    ("phishing", "PR-001", "Включить защищенную почтовую фильтрацию",
     "Активировать антифишинговые правила и sandbox-анализ вложений.", 1),
    ("phishing", "PR-002", "Провести принудительную смену паролей",
     "Сменить пароли критичных пользователей и проверить повторное использование учетных данных.", 2),
    ("phishing", "PR-003", "Запустить обучение сотрудников",
     "Провести короткую кампанию по распознаванию фишинговых писем.", 3),
    ("brute_force", "PR-004", "Настроить политику паролей",
     "Установить длину, сложность, историю паролей и запрет на слабые комбинации для внешних точек входа.", 1),
    ("brute_force", "PR-005", "Включить 2FA",
     "Обязать MFA/2FA для VPN, администраторов и всех пользователей с удалённым доступом.", 2),
    ("brute_force", "PR-014", "Ограничить попытки входа",
     "Настроить rate limiting, блокировки по IP и временный lockout после серии неуспешных входов.", 3),
    ("ransomware", "PR-006", "Проверить резервные копии",
     "Убедиться, что резервные копии изолированы и восстановление проходит успешно.", 1),
    ("ransomware", "PR-007", "Ограничить lateral movement",
     "Сегментировать сеть и ограничить доступ между рабочими станциями и серверами.", 2),
    ("sql_injection", "PR-008", "Включить WAF-правила",
     "Активировать правила защиты от SQL-инъекций для внешнего веб-контура.", 1),
    ("sql_injection", "PR-009", "Проверить параметризованные запросы",
     "Исключить динамическую конкатенацию SQL-строк в коде.", 2),
    ("malware", "PR-010", "Обновить EDR/AV-политики",
     "Усилить правила детектирования и запретить запуск неподписанных файлов.", 1),
    ("malware", "PR-011", "Ограничить права локальных пользователей",
     "Убрать локальные административные права у офисных рабочих станций.", 2),
    ("credential_stuffing", "PR-012", "Проверить утечки учетных данных",
     "Сопоставить логины сотрудников с известными утечками и инициировать смену паролей.", 1),
    ("credential_stuffing", "PR-013", "Включить контроль аномального входа",
     "Настроить алерты на массовые неуспешные логины и геоаномалии.", 2),
)

# ---- request building -------------------------------------------------------------------
REQUEST_DEFAULTS = {
    "region": "Moscow",
    "industry": "telecom",
    "asset_type": "vpn_gateway",
    "has_external_access": True,
    "privileged_accounts_count": 12,
    "known_vulnerabilities_count": 3,
    "prefer_ml": False,
}
REGION_ALIASES = {
    "MSK": "Moscow",
    "SPB": "Saint Petersburg",
    "SIB": "Novosibirsk",
    "FAR_EAST": "Vladivostok",
    "Moscow": "Moscow",
    "Saint Petersburg": "Saint Petersburg",
    "Novosibirsk": "Novosibirsk",
    "Vladivostok": "Vladivostok",
}
INDUSTRY_ALIASES = {
    "Finance": "finance",
    "Telecom": "telecom",
    "Retail": "retail",
    "Gov": "government",
    "finance": "finance",
    "telecom": "telecom",
    "retail": "retail",
    "government": "government",
}
CLOCK_BASE_HOURS = 3
CLOCK_OFFSET_HOURS = {"MSK": 0, "SPB": 0, "SIB": 4, "FAR_EAST": 7}
HOSTS_PER_ACCOUNT = 40
HOSTS_PER_VULNERABILITY = 100
ASSET_BY_TECHNOLOGY = (("network", "vpn_gateway"), ("sql", "db_server"), ("web", "web_portal"))
EXTERNAL_TECHNOLOGIES = ("web", "network")

# ---- display labels ------------------------------------------------------------------------
METHOD_LABELS = {
    "malware": "вредоносное ПО",
    "phishing": "фишинг",
    "brute_force": "подбор учётных данных",
    "ransomware": "шифровальщик",
    "sql_injection": "SQL-инъекция",
    "credential_stuffing": "компрометация учётных данных",
}
TARGET_LABELS = {
    "workstation": "Рабочая станция",
    "vpn_gateway": "VPN / сеть",
    "mail_gateway": "Почта",
    "web_portal": "Веб / портал",
    "db_server": "БД",
    "file_server": "Файлы",
    "crm": "CRM",
}
SEASON_LABELS = {"winter": "Зима", "spring": "Весна", "summer": "Лето", "autumn": "Осень"}
TIME_OF_DAY_LABELS = {"morning": "Утро", "afternoon": "День", "evening": "Вечер", "night": "Ночь"}
EMPTY_LABEL = "Нет данных в выборке"
HEATMAP_DAY = "Текущая выборка"

# ---- region-hour model -----------------------------------------------------------------------
LAGS = (1, 2, 3, 6, 12, 24)
ROLLING = (6, 24)
PEAK_HOURS = (10, 11, 14, 15, 16, 17)
WORKING_HOURS = (9, 18)
CATEGORICAL_FEATURES = (
    "region", "dominant_org_type", "dominant_threat_source", "dominant_impact_object", "season", "day_period",
)
NUMERIC_FEATURES = (
    ("incidents_count", "unique_enterprises", "unique_threats", "avg_host_count", "median_host_count",
     "avg_host_count_log", "median_host_count_log", "threat_danger_score", "hour", "dayofweek", "month",
     "quarter", "is_weekend", "is_working_hours", "is_peak_hours")
    + tuple(f"lag_{what}_{k}" for what in ("attack", "incidents", "success") for k in LAGS)
    + tuple(f"rolling_{what}_{k}" for what in ("attack_mean", "incidents_sum", "success_sum") for k in ROLLING)
)
LOOKBACK_DAYS = 90
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.30, 0.02, 26
SAVED_THRESHOLD = 0.6400000000000003
FOLDS = 3
SEED = 42
PATIENCE = 50  # rounds without a better validation loss before boosting ends
BOOSTING = {"iterations": 700, "depth": 6, "learning_rate": 0.08}
GRID = (
    {"iterations": 400, "depth": 6, "learning_rate": 0.07},
    {"iterations": 500, "depth": 5, "learning_rate": 0.08},
    {"iterations": 600, "depth": 7, "learning_rate": 0.06},
    {"iterations": 450, "depth": 6, "learning_rate": 0.09},
)
FOREST_TREES = 200
FOREST_MIN_ROWS = 10
HOSTS_PER_PRIVILEGED_ACCOUNT = 20
DANGER_BANDS = ((0.6, "high"), (0.4, "medium"))

# Sentences of the model rationales.
FOREST_NOTES = (
    "ML model trained on %d historical incidents from the local dataset.",
    "Primary prediction features: region %s, industry %s, season %s, hour %d.",
    "Model confidence for method/target classes: %s/%s.",
)
TEMPORAL_NOTES = (
    "Temporal risk score (probability): %s.",
    "Attack method / target object are taken from historical distribution for your org or region; "
    "fallback: heuristic from asset type (%s).",
)
