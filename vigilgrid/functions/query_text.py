"""Annotations of search texts, as columns over a whole query table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from vigilgrid.functions.text import collapse_spaces, singular, tokens

# The words the search vocabulary knows.
COLOURS = ["red", "blue", "green", "yellow", "black", "white", "grey", "silver", "orange", "purple",
           "brown", "pink", "beige"]
VEHICLE_STYLES = ["suv", "sedan", "truck", "van", "motorcycle", "bus"]
PERSON_ATTRIBUTES = ["backpack", "bag", "umbrella", "jacket", "shirt", "pants", "shorts", "skirt", "hat",
                     "helmet", "laptop", "phone", "vest", "hi-vis", "hard hat"]
OBJECT_CLASSES = ["person", "car", "bicycle", "motorcycle", "bus", "truck", "backpack"]
CLASS_OF_WORD = {"man": "person", "woman": "person", "child": "person", "people": "person",
                 "individual": "person", "auto": "car", "vehicle": "car", "automobile": "car", "cab": "car",
                 "taxi": "car", "forklift": "truck", "rider": "person", "cyclist": "person"}
PERSON_WORDS = ["man", "woman", "child", "person", "people", "individual", "rider", "cyclist"]
ACTIONS = ["reversing", "running", "walking", "moving", "entering", "leaving", "turning"]
WORN_OR_CARRIED = ["backpack", "umbrella", "jacket", "shirt", "pants", "shorts", "skirt", "hat", "laptop", "phone"]
TRACKING_PHRASES = ["same person", "same car", "same vehicle", "track the same", "cross-camera"]

SYNONYMS = {
    "car": ["vehicle", "automobile", "motorcar", "sedan", "suv"],
    "truck": ["vehicle", "pickup", "lorry", "carrier", "semi"],
    "vehicle": ["car", "truck", "bus", "van", "automobile"],
    "person": ["man", "woman", "pedestrian", "human", "child", "people"],
    "man": ["person", "human", "pedestrian"],
    "woman": ["person", "human", "pedestrian"],
    "pedestrian": ["person", "pedestrian", "human", "walker"],
    "backpack": ["bag", "luggage", "pack", "sack"],
    "luggage": ["bag", "suitcase", "backpack", "handbag", "briefcase"],
    "suitcase": ["luggage", "bag", "backpack"],
    "bicycle": ["bike", "cycle", "two-wheeler"],
    "bike": ["bicycle", "motorcycle", "cycle"],
    "fire": ["smoke", "flame", "blaze", "heat"],
    "smoke": ["fire", "haze", "exhaust"],
    "dog": ["animal", "pet", "canine"],
    "cat": ["animal", "pet", "feline"],
}
KNOWN_CLASSES = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard",
    "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors",
    "teddy bear", "hair drier", "toothbrush", "luggage", "vehicle", "fire", "smoke", "van"]
BASE_OF_PLURAL = {"people": "person", "pedestrians": "person", "autos": "car", "cars": "car",
                  "vans": "vehicle", "trucks": "truck", "backpacks": "backpack", "bags": "luggage"}

COUNT_WORDS = ["how many", "count", "number of", "total", "average"]
COMPARE_WORDS = ["which camera", "compare", "busiest", "most", "least"]
EVENT_WORDS = ["loitering", "fighting", "intrusion", "falling", "abandoned", "tailgating"]

HOURS_OF_PERIOD = {"morning": (6, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 6)}
SECONDS_OF_UNIT = {"h": 3600, "m": 60, "s": 1, "d": 86400}

# The terms, phrases and patterns by which a text is read when no model answers.
ENTITY_COLOURS = ["red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey", "brown", "silver", "gold",
                  "beige", "navy", "maroon", "teal", "cyan", "magenta", "olive", "burgundy", "tan", "khaki", "dark", "light", "bright", "neon"]
COLOUR_PHRASES = ["dark blue", "light blue", "dark green", "light green", "dark red", "bright red", "neon green", "navy blue"]
CLOTHING = ["jacket", "coat", "hoodie", "sweater", "shirt", "t-shirt", "tshirt", "vest", "uniform", "dress", "skirt", "pants", "jeans", "shorts",
            "hat", "cap", "helmet", "mask", "scarf", "gloves", "glasses", "sunglasses", "backpack", "bag", "handbag", "briefcase", "purse",
            "suitcase", "luggage", "boots", "shoes", "sneakers", "sandals", "high-vis", "reflective", "apron", "hard hat", "headband"]
CLOTHING_PHRASES = ["hard hat", "high-vis", "t-shirt"]
VEHICLE_KINDS = ["sedan", "suv", "truck", "van", "bus", "motorcycle", "bike", "bicycle", "minivan", "pickup", "hatchback", "coupe", "convertible",
                 "wagon", "jeep", "taxi", "ambulance", "police car", "fire truck", "scooter", "moped", "skateboard", "e-scooter", "forklift",
                 "tractor", "trailer", "semi", "lorry", "rig", "rv", "camper"]
VEHICLE_PHRASES = ["police car", "fire truck", "e-scooter"]
BEHAVIOURS = ["running", "walking", "standing", "sitting", "loitering", "fighting", "falling", "crawling", "jumping", "climbing", "entering",
              "exiting", "crossing", "waiting", "talking", "smoking", "carrying", "dropping", "throwing", "pushing", "pulling", "dragging",
              "following", "chasing", "hiding", "crouching", "kneeling", "lying", "sleeping", "waving", "pointing", "gesturing", "arguing",
              "shoplifting", "trespassing", "vandalizing", "speeding", "parking", "driving", "stopped"]
ENTITY_CLASSES = ["person", "people", "man", "woman", "child", "kid", "pedestrian", "car", "vehicle", "truck", "bus", "bicycle", "motorcycle",
                  "dog", "cat", "bird", "animal", "backpack", "suitcase", "luggage", "bag", "package", "box", "phone", "laptop", "umbrella",
                  "bottle", "gun", "knife", "weapon", "fire", "smoke", "flame"]
CLASS_OF_ENTITY = {"people": "person", "man": "person", "woman": "person", "child": "person", "kid": "person", "pedestrian": "person",
                   "vehicle": "car"}
QUANTITY = r"\b(\d+)\s+(?:people|persons?|cars?|vehicles?|trucks?)\b"
NEGATION = (r"\b(?:not|without|no|except|excluding)\s+([\w\s]+?)"
            r"(?:\s+(?:in|on|at|from|near|cam|camera|zone|between|last|today|yesterday)|$)")
PLACE = (r"\b(?:in|near|at)\s+(?:the\s+)?((?:parking\s+lot|loading\s+dock|lobby|corridor|warehouse|server\s+room|rooftop|emergency\s+exit"
         r"|zone\s+\w+)(?:\s+\w)?)")
ENTITY_WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"

INJECTION_PHRASES = [
    r"ignore\s+(?:all\s+)?previous\s+instructions", r"ignore\s+above\s+instructions", r"system\s+prompt",
    r"you\s+are\s+now\s+in\s+developer\s+mode", r"bypass\s+restrictions", r"dan\s+mode", r"jailbreak",
    r"as\s+an\s+ai\s+without\s+restrictions", r"you\s+must\s+now\s+act\s+as"]
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,5}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
SCRUBBED = [
    r"(?i)(?:--|;|'|\"|\bDROP\b|\bDELETE\b|\bINSERT\b|\bUPDATE\b|\bSELECT\b)",
    r"(?i)\bignore\s+(?:above|previous)\s+instructions?\b", r"(?i)\byou\s+are\s+now\b", r"(?i)\bsystem\s*:\s*"]


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _has_any(text: Column, phrases) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def _known(items: Column, values) -> Column:
    return F.filter(items, lambda w: w.isin(*values))


def search_intent(query: Column) -> Column:
    """Struct of intent fields for one search text; later words win over earlier ones."""
    text = F.trim(F.lower(query))
    words = tokens(text)
    single = [a for a in PERSON_ATTRIBUTES if a.isalpha()]
    context = sorted((set(PERSON_WORDS) | set(single)) - {"backpack"})
    about_person = F.arrays_overlap(words, _words(context))
    class_map = _map({**{c: c for c in OBJECT_CLASSES}, **CLASS_OF_WORD})
    class_words = F.filter(words, lambda w: F.map_contains_key(class_map, w)
                           & ~((w == "backpack") & about_person))
    direct = F.element_at(class_map, _last(class_words))
    style = F.upper(_last(_known(words, VEHICLE_STYLES)))
    attributes = F.array_sort(F.array_distinct(F.concat(
        _known(words, single),
        F.when(text.contains("hard hat"), _words(["hard hat"])).otherwise(F.array().cast("array<string>")),
        F.when(text.contains("hi-vis") | text.contains("safety vest"), _words(["hi-vis vest"]))
        .otherwise(F.array().cast("array<string>")))))
    other = F.size(F.array_remove(attributes, "backpack")) > 0
    worn = F.arrays_overlap(attributes, _words(WORN_OR_CARRIED))
    object_class = (F.when((direct == "backpack") & other, F.lit("person")).when(direct.isNotNull(), direct)
                    .when(worn, F.lit("person")).when(style.isNotNull(), F.lit("car")))
    hours = F.regexp_extract(text, r"last\s+(\d+)\s+hours?", 1)
    action = _last(_known(words, ACTIONS))
    zone = F.regexp_extract(text, r"zone[-_\s]([a-b])", 1)
    return F.struct(
        F.when(_has_any(text, TRACKING_PHRASES), F.lit("cross_camera_track")).otherwise(F.lit("object_search"))
        .alias("intent_type"),
        object_class.alias("object_class"), _last(_known(words, COLOURS)).alias("color"),
        style.alias("vehicle_style"), attributes.alias("attributes"),
        _last(_known(words, ["man", "woman", "child"])).alias("gender"),
        F.when(zone != "", F.concat(F.lit("zone_"), zone)).alias("spatial_zone"),
        F.when(hours != "", hours.cast("double")).when(_has_any(text, ["last hour", "past hour"]), F.lit(1.0))
        .when(text.contains("today"), F.lit(24.0)).alias("time_range_hours"),
        action.alias("action"), action.isNotNull().alias("is_action_query"))


def normal_class(word: Column) -> Column:
    """Taxonomy class of a possibly plural word, null when unknown."""
    w, s = F.lower(word), singular(F.lower(word))
    base = _map(BASE_OF_PLURAL)
    return (F.when(w.isin(*KNOWN_CLASSES), w).when(s.isin(*KNOWN_CLASSES), s)
            .otherwise(F.coalesce(F.element_at(base, w), F.element_at(base, s))))


def filter_terms(query: Column) -> Column:
    """Cameras, zone, wanted and excluded classes and synonyms written into a search text."""
    raw = F.trim(query)
    cameras = F.regexp_extract_all(raw, F.lit(r"(?i)\b(?:cam|camera):([\w\-]+)"), 1)
    text = F.regexp_replace(raw, r"(?i)\b(?:on\s+)?(?:cam|camera):[\w\-]+", "")
    keyed = F.regexp_extract(text, r"(?i)\bzone:([\w\-]+)", 1)
    spoken = F.regexp_extract(text, r"(?i)\bin zone\s+([\w\-]+)", 1)
    text = F.when(keyed != "", F.regexp_replace(text, r"(?i)\bzone:[\w\-]+", "")).otherwise(
        F.regexp_replace(text, r"(?i)\bin zone\s+[\w\-]+", ""))
    negated = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:but\s+)?not\s+(\w+s?)"), 1),
                       F.regexp_extract_all(text, F.lit(r"(?i)\bexcept\s+(\w+s?)"), 1),
                       F.regexp_extract_all(text, F.lit(r"(?i)\bno\s+(\w+s?)"), 1))
    excluded = _classes(negated)
    for pattern in (r"(?i)\b(?:but\s+)?not\s+\w+s?", r"(?i)\bexcept\s+\w+s?", r"(?i)\bno\s+\w+s?",
                    r"(?i)\blast\s+\d+\s*(?:hours?|h|minutes?|mins?|m)\b"):
        timed = text.rlike(pattern)  # of the last pattern, once the loop is over
        text = F.regexp_replace(text, pattern, "")
    # One time phrase is taken out: a stretch, else today, else yesterday.
    word = F.when(text.rlike(r"(?i)\btoday\b"), F.lit(r"(?i)\btoday\b")).otherwise(F.lit(r"(?i)\byesterday\b"))
    text = F.when(timed, text).otherwise(F.regexp_replace(text, word, F.lit("")))
    text = collapse_spaces(text)
    wanted = F.array_sort(F.array_except(_classes(tokens(text)), excluded))
    return F.struct(cameras.alias("camera_ids"),
                    F.when(keyed != "", keyed).when(spoken != "", spoken).alias("spatial_zone"),
                    wanted.alias("classes"), excluded.alias("excluded_classes"), text.alias("semantic_query"))


def _classes(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, normal_class), lambda c: c.isNotNull())))


def synonyms_of(classes: Column) -> Column:
    """Dictionary expansion of a class list, sorted; a class is never its own synonym."""
    table = F.create_map(*chain.from_iterable((F.lit(k), _words(v)) for k, v in SYNONYMS.items()))
    found = F.flatten(F.transform(classes, lambda c: F.filter(
        F.coalesce(F.element_at(table, c), F.array().cast("array<string>")), lambda s: s != c)))
    return F.array_sort(F.array_distinct(found))


def question_type(query: Column) -> Column:
    text = F.lower(query)
    return (F.when(_has_any(text, COUNT_WORDS), "statistical_query").when(_has_any(text, COMPARE_WORDS), "comparison")
            .when(_has_any(text, EVENT_WORDS), "event_search").otherwise("object_search"))


def _mentioned(text: Column, words: Column, terms: list[str], phrases: list[str] = ()) -> Column:
    """Terms among the words and phrases anywhere in the text, sorted, each once."""
    found = _known(words, terms)
    if phrases:
        found = F.concat(found, F.filter(_words(phrases), lambda p: F.contains(text, p)))
    return F.array_sort(F.array_distinct(found))


def entities(query: Column) -> Column:
    """Struct of what a text names: colours, clothing, vehicle kinds, behaviours, object classes and quantities.

    Lists are sorted and hold each term once; quantities stand in the order of the text. A null text names nothing.
    """
    text = F.lower(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(text, F.lit(ENTITY_WORD), 0)
    return F.struct(
        _mentioned(text, words, ENTITY_COLOURS, COLOUR_PHRASES).alias("colors"),
        _mentioned(text, words, CLOTHING, CLOTHING_PHRASES).alias("clothing"),
        _mentioned(text, words, VEHICLE_KINDS, VEHICLE_PHRASES).alias("vehicle_types"),
        _mentioned(text, words, BEHAVIOURS).alias("behaviors"), _mentioned(text, words, ENTITY_CLASSES).alias("object_classes"),
        F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), 1), lambda n: n.try_cast("long")).alias("quantities"))


def entity_summary(found: Column) -> Column:
    """One line that names the non-empty lists of ``entities``."""
    titles = {"object_classes": "Objects", "colors": "Colors", "clothing": "Clothing", "vehicle_types": "Vehicle types",
              "behaviors": "Behaviors", "quantities": "Quantities"}
    parts = [F.when(F.size(found[f]) > 0, F.concat(F.lit(f"{title}: "), F.array_join(found[f].cast("array<string>"), ", ")))
             for f, title in titles.items()]
    line = F.concat_ws("; ", *parts)
    return F.when(line == "", F.lit("No specific entities detected.")).otherwise(line)


def plain_intent(query: Column) -> Column:
    """Intent of a text read by terms and patterns alone: class, colour, attributes, negations, zone and event.

    A zone takes in one more letter or digit after its name, as in "server room a" (of a longer word, its first).
    """
    text = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    found = entities(query)
    first = F.get(found["object_classes"], F.lit(0))
    kind = question_type(text)
    event = F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in EVENT_WORDS])
    zone = F.trim(F.regexp_extract(text, PLACE, 1))
    negations = F.transform(F.regexp_extract_all(text, F.lit(NEGATION), 1), lambda n: F.trim(n))
    return F.struct(
        F.coalesce(F.element_at(_map(CLASS_OF_ENTITY), first), first, F.when(F.size(found["vehicle_types"]) > 0, F.lit("car"))).alias("object_class"),
        F.get(found["colors"], F.lit(0)).alias("color"),
        F.concat(found["clothing"], found["behaviors"], found["vehicle_types"]).alias("attributes"),
        F.filter(negations, lambda n: n != "").alias("negations"), camera_mentions(text).alias("camera_ids"),
        F.when(zone != "", zone).alias("spatial_zone"), kind.alias("intent_type"),
        F.when(kind == "event_search", event).alias("event_type"))


def camera_mentions(query: Column) -> Column:
    """Cameras named like "cam 7", as cam-007."""
    numbers = F.regexp_extract_all(F.lower(query), F.lit(r"\bcam(?:era)?[-_\s]?(\d+)\b"), 1)
    return F.transform(numbers, lambda n: F.concat(
        F.lit("cam-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def time_range(query: Column, at: Column) -> Column:
    """Start and end (epoch ms) of a time phrase relative to the text's own timestamp ``at``."""
    text = F.trim(F.lower(query))
    now = F.unix_millis(at)
    day = F.unix_millis(F.date_trunc("day", at))
    hour_ms, day_ms = 3_600_000, 86_400_000
    last = r"\blast\s+(\d+)\s*(hours?|h|minutes?|mins?|m|seconds?|secs?|s|days?|d)\b"
    unit = F.substring(F.regexp_extract(text, last, 2), 1, 1)
    seconds = _map({k: str(v) for k, v in SECONDS_OF_UNIT.items()})
    back = F.regexp_extract(text, last, 1).try_cast("long") * F.element_at(seconds, unit).cast("long") * 1000
    between = r"\bbetween\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s+and\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"

    def clock(h: int) -> Column:
        hour = F.regexp_extract(text, between, h).try_cast("long")
        minute = F.coalesce(F.regexp_extract(text, between, h + 1).try_cast("long"), F.lit(0))
        noon = F.regexp_extract(text, between, h + 2)
        hour = F.when((noon == "pm") & (hour != 12), hour + 12).when((noon == "am") & (hour == 12), 0).otherwise(hour)
        return day + hour * hour_ms + minute * 60_000

    def period(word: str, base: Column, open_end: Column) -> tuple[Column, Column]:
        name = F.regexp_extract(text, rf"\b{word}\s+(morning|afternoon|evening|night)\b", 1)
        start, end = base, open_end
        for p, (a, b) in HOURS_OF_PERIOD.items():
            start = F.when(name == p, base + a * hour_ms).otherwise(start)
            end = F.when(name == p, base + (b + (24 if b <= a else 0)) * hour_ms).otherwise(end)
        return start, end

    today = period("today", day, now)
    yesterday = period("yesterday", day - day_ms, day - 1)
    monday = F.unix_millis(F.date_trunc("week", at))
    rules = [(text.rlike(last), now - back, now), (text.rlike(between), clock(1), clock(4)),
             (text.rlike(r"\btoday\b"), *today), (text.rlike(r"\byesterday\b"), *yesterday),
             (text.rlike(r"\bthis\s+week\b"), monday, now)]
    start = end = F.lit(None).cast("long")
    for test, s, e in reversed(rules):
        start, end = F.when(test, s).otherwise(start), F.when(test, e).otherwise(end)
    return F.struct(start.alias("start_ms"), end.alias("end_ms"))


def scrub(query: Column, longest: int = 2000) -> Column:
    """Card, SSN, phone and email masks in that order, injection fragments out, spaces collapsed."""
    text = F.substring(F.trim(query), 1, longest)
    for pattern, mask in ((CARD, "[CARD]"), (SSN, "[SSN]"), (PHONE, "[PHONE]"), (EMAIL, "[EMAIL]")):
        text = F.regexp_replace(text, pattern, mask)
    for pattern in SCRUBBED:
        text = F.regexp_replace(text, pattern, "")
    return collapse_spaces(text)


def is_injection(query: Column) -> Column:
    return F.lower(query).rlike("|".join(f"(?:{p})" for p in INJECTION_PHRASES))
