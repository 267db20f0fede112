"""Values that results depend on: layouts, word lists, patterns and texts.

Everything here is a fixed value of the data or of the report texts; nothing
here is logic.
"""

# Column order of the observation files.
OBSERVATION_COLUMNS = [
    "hotel_name",
    "price",
    "dates",
    "duration",
    "rating",
    "departure_airport",
    "scraped_at",
    "url",
    "image_url",
    "offer_url",
]

# Column that only some files have.
OPTIONAL_AIRPORT_COLUMN = "from_airport"

# Field length limits of a parsed offer.
NAME_LIMIT = 100
DATES_LIMIT = 50
DURATION_LIMIT = 30
RATING_LIMIT = 20
MIN_TEXT_LENGTH = 10
NAME_FALLBACK_WORDS = 5

# Default thresholds.
ALERT_THRESHOLD_PCT = 4.0
SNAPSHOT_THRESHOLD = 100.0
PRICE_CAP = 8000.0
RUN_GAP = "5 minutes"
TOP_N = 10
RETENTION_DAYS = 30
MOVER_HOURS = (24, 48, 168)
EXTREME_DAYS = (7, 30)
REPORT_LIMIT = 20
PAGE_SIZE = 50

# Departure airports, code -> display name.
AIRPORT_NAMES = {
    "Warszawa": "Варшава",
    "Warszawa-Radom": "Варшава-Радом",
    "Krakow": "Краков",
    "Gdansk": "Гданьск",
    "Wroclaw": "Вроцлав",
    "Poznan": "Познань",
    "Katowice": "Катовице",
    "Lodz": "Лодзь",
    "Rzeszow": "Жешув",
    "Bydgoszcz": "Быдгощ",
    "Szczecin": "Щецин",
    "Lublin": "Люблин",
    "Olsztyn": "Ольштын",
    "Zielona-Gora": "Зелена-Гура",
    "Bialystok": "Белосток",
    "Rzeszow-Jasionka": "Жешув-Ясьонка",
}
BASE_AIRPORT = "Warszawa"
ALL_AIRPORTS = "Все аэропорты"
UNKNOWN_AIRPORT = "Неизвестно"
OTHER_CITY = "Другой город"
OTHER_AIRPORTS = "Другие аэропорты"

# Words and patterns met in offer texts.
WHOLE_PARTY_MARKERS = ["za wszystkich", "za wszystkie"]
RATING_WORDS = ["tripadvisor", "ocena", "opinii", "rating", "stars"]
DATE_RANGE_PATTERNS = [
    r"\d{1,2}\.\d{1,2}\.\d{4}\s*-\s*\d{1,2}\.\d{1,2}\.\d{4}",
    r"\d{1,2}\.\d{1,2}\s*-\s*\d{1,2}\.\d{1,2}",
    r"\d{1,2}/\d{1,2}/\d{4}\s*-\s*\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}\s*-\s*\d{1,2}-\d{1,2}-\d{4}",
]
DURATION_UNITS = ["dni", "noclegów", "days", "nights", "noclegi"]
DURATION_DEFAULT_UNIT = "dni"
DEFAULT_DATES = "20-09-2025 - 04-10-2025"
DEFAULT_DURATION = "6-15 дней"
DURATION_RANGE_UNIT = "дней"
IMAGE_ATTRIBUTES = ["src", "data-src", "data-original", "data-lazy"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
NAME_CLASSES = ["title", "name", "hotel-name", "offer-title"]
NAME_CLASS_PARTS = ["title", "name", "hotel"]
WHOLE_PARTY_CLASS = "price-view-2"
PRICE_CLASSES = ["price", "cost", "amount", "value"]
PRICE_CLASS_PARTS = ["price", "cost", "amount"]
DATE_CLASSES = ["date", "dates", "departure-date", "arrival-date", "travel-date", "trip-date", "journey-date"]
DATE_CLASS_PARTS = ["date", "departure", "arrival", "travel", "trip", "journey"]
DATE_ATTRIBUTES = ["data-date", "data-departure", "data-arrival"]
DATE_LAST_CLASSES = ["period", "range", "from-to", "time", "when", "schedule"]
DURATION_CLASSES = ["duration", "nights", "days", "length", "trip-duration", "stay-duration", "period"]
DURATION_CLASS_PARTS = ["duration", "nights", "days", "length", "period"]
DURATION_ATTRIBUTES = ["data-duration", "data-nights", "data-days"]
LINK_CLASSES = ["image-link", "offer-con"]
OFFER_PATH = "/wycieczka/"
DESTINATION_PATH = "/kierunek/"

# Price bands of the hotel table, both ends inclusive.
PRICE_BANDS = [
    ("0-5000", None, 5000.0),
    ("5000-6000", 5000.0, 6000.0),
    ("6000-7000", 6000.0, 7000.0),
    ("7000-8000", 7000.0, 8000.0),
    ("8000-9000", 8000.0, 9000.0),
    ("9000+", 9000.0, None),
]

# Status texts and marks.
STATUS_DROP = ("📉 СНИЖЕНИЕ", "green")
STATUS_RISE = ("📈 ПОВЫШЕНИЕ", "red")
STATUS_SAME = ("➡️ БЕЗ ИЗМЕНЕНИЙ", "gray")
NEW_MINIMUM = "Новый минимум %dд"
NEW_MAXIMUM = "Новый максимум %dд"
MISSING_NOTE = "Отель отсутствует в результатах поиска"
MISSING_NOTE_LIMIT = " (вероятно цена > %d PLN либо предложение снято)"
MISSING_FEED_TEXT = "Отель пропал из выдачи"
UNKNOWN_HOTEL = "Unknown"
NO_VALUE = "—"
TOP_TITLE = "📊 ТОП-%d (%s)"

# Display formats.
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
HEADER_FORMAT = "dd.MM.yyyy HH:mm"
KEY_TIME_FORMAT = "yyyy-MM-dd_HH-mm"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Defaults laid under a schedule definition.
SCHEDULE_DEFAULTS = {
    "enabled": "true",
    "intervals.daily": "09:00",
    "intervals.hourly": "false",
    "intervals.custom_hours": "[9,15,21]",
    "notifications.enabled": "false",
    "notifications.telegram_bot_token": "",
    "notifications.telegram_chat_id": "",
    "data_retention_days": "30",
    "min_price_change_threshold": "100",
}
