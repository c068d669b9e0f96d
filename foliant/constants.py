"""The vocabulary, thresholds and formats results depend on."""

OK, WARNING, ERROR = "OK", "WARNING", "ERROR"

# Canonical (Spanish) month names written to output, January first.
MONTH_NAMES = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN",
               "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")
# Spanish and English month words accepted on input, with their number.
MONTH_WORDS = (("ENE", 1), ("JAN", 1), ("FEB", 2), ("MAR", 3), ("ABR", 4), ("APR", 4),
               ("MAY", 5), ("JUN", 6), ("JUL", 7), ("AGO", 8), ("AUG", 8), ("SEP", 9),
               ("OCT", 10), ("NOV", 11), ("DIC", 12), ("DEC", 12))
# Month names used on separators and file names.
MONTH_NAMES_EN = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
                  "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Formats.
LOG_NUMBER_RE = r"^\d{7}$"
REGISTRATION_RE = r"^HP-\d{4}(?:CMP|WWP)$"
INDEX_REGISTRATION_RE = r"^(?:HP|HK)-\d{4}(?:CMP|WWP)?$"
DATE_RE = r"^\d{4}/\d{2}/\d{2}$"

# Sort position of pages whose log number cannot be read (2**30).
UNREADABLE_ORDER = 1073741824
NO_REGISTRATION = "sin_matricula"
NO_MONTH = "sin_fecha"
UNKNOWN_BOOK = "unknown"

# Registration vote: weight floor and quality of each kind of reading.
MIN_VOTE_WEIGHT = 0.05
QUALITY_CLEAN, QUALITY_AMBIGUOUS, QUALITY_WEAK = 1.0, 0.8, 0.25
AMBIGUOUS_REGISTRATION_NOTE = "registration: handwritten characters read as digits"
WEAK_REGISTRATION_NOTE = "registration: digits inferred from scattered OCR (low confidence)"
NO_REGISTRATION_NOTE = "registration without 4-digit number"
WWP_NUMBERS = ("1522", "1990")
DERIVED_SOURCES = ("book_correction", "inferred")
VERIFIED_SOURCES = ("ocr_fallback", "vlm", "fleet_validation")

# Date inference.
MIN_ANCHOR_CONFIDENCE = 0.5
MIN_POSITIONAL_MONTH_CONFIDENCE = 0.35
MAX_EDGE_SPAN = 10
ANCHOR_STOP_WORDS = ("fuzzy", "numeric handwritten month", "low confidence",
                     "conflicts with", "regression")
POSITIONAL_STOP_WORDS = ("fuzzy", "numeric handwritten month", "conflict")
POSITIONAL_METHODS = ("ranuras", "date_cells")
YEAR_MIN_READINGS, YEAR_MIN_COUNT, YEAR_MIN_RATIO = 3, 2, 0.60

# Nearest fleet match: digit pairs the handwriting confuses, and the costs.
CONFUSABLE_DIGITS = ("17", "27", "12", "14", "47", "49", "07", "38", "35",
                     "58", "56", "68", "08", "06", "09")
DIFFERENT_DIGIT_COST, CONFUSABLE_DIGIT_COST, SUFFIX_COST = 10, 6, 5

SIGNATURE_FIELDS = ("pilot_signature", "captain_signature", "captain_license",
                    "technician_license", "technician_signature")
PRESENT_CONFIDENCE, ABSENT_CONFIDENCE = 0.45, 0.55
LOW_CONFIDENCE = 0.5
DATE_FIELDS = ("day", "month", "year")
MANUAL_FIELDS = ("matricula", "day", "month", "year", "log_number")

# Remote index: field ids, page states and the mandatory fields.
FIELD_DOC_TYPE, FIELD_REGISTRATION, FIELD_FLEET = 9586, 9633, 9699
FIELD_LOG_NUMBER, FIELD_AUDIT_STATUS, FIELD_END_DATE = 9675, 9754, 9593
FIELD_LESSOR, FIELD_BATCH_NAME = 9783, 9631
MANDATORY_FIELDS = (FIELD_DOC_TYPE, FIELD_REGISTRATION, FIELD_FLEET,
                    FIELD_LOG_NUMBER, FIELD_AUDIT_STATUS, FIELD_END_DATE)
STATE_VALID = 0
# Fallback fleet by registration prefix, first match wins; otherwise the default.
FLEET_PREFIXES = (("HK-", "EMB"), ("HP-98", "MAX"), ("HP-99", "MAX"))
DEFAULT_FLEET = "NG"
DOC_TYPE, AUDIT_STATUS = "Log Page", "PUBLISHED"
STAGES = ("procesar", "preparar", "subir", "descubrir", "indexar", "verificar")
DONE_STAGES = ("hecha", "omitida")

# Letters read in place of a handwritten digit.
LETTER_DIGITS = {"O": "0", "o": "0", "Q": "0", "I": "1", "i": "1", "l": "1", "!": "1",
                 "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "8",
                 "G": "6", "g": "6"}

# Flight-number vocabulary and the strokes the recogniser confuses.
FLIGHT_CODES = ("TCK", "CCK", "SPV", "SVC", "SUP", "MTC", "SV")
FLIGHT_STROKES = ("0OQD", "1IL", "2Z", "3E", "4YA", "5S", "6G", "7TFJ", "8B", "9PR", "UV")
FLIGHT_NOTE = "flight number matched against the logbook vocabulary"

# Signature thresholds, in the order peak, empty peak, span, dark ratio, and guards.
MIN_INK_PEAK, MAX_EMPTY_PEAK, MIN_INK_SPAN, MAX_INK_RATIO = 0.12, 0.05, 0.30, 0.60
PEAK_GRID = tuple(round(0.03 + 0.01 * i, 3) for i in range(28))
EMPTY_GRID = tuple(round(0.01 + 0.01 * i, 3) for i in range(15))
SPAN_GRID = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70, 1.0)
COST_FALSE_PRESENT, COST_FALSE_ABSENT, COST_UNCLEAR = 6, 4, 1
MIN_RESOLVED = 0.80
