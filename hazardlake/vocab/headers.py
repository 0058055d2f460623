"""Fixed header synonyms and field hints used to map any file on the report schema."""

# Canonical fields, in mapping order.
CANONICAL_FIELDS = [
    "text",
    "title",
    "date",
    "site",
    "activity",
    "report_type",
    "report_id",
    "hazard",
    "consequence",
    "barrier_failure",
    "location",
    "equipment",
    "unsafe_type",
    "rule",
]

# Header synonym and weight per canonical field.
HEADER_SYNONYMS = {
    "text": [
        ("what happened", 110),
        ("report", 100),
        ("description", 95),
        ("narrative", 95),
        ("observation", 90),
        ("incident detail", 85),
        ("occurrence", 75),
        ("details", 75),
        ("text", 70),
        ("statement", 70),
        ("summary", 65),
        ("remarks", 60),
        ("comments", 55),
        ("notes", 50),
    ],
    "title": [
        ("title", 100),
        ("subject", 90),
        ("headline", 80),
        ("heading", 75),
        ("short description", 60),
    ],
    "date": [
        ("date", 90),
        ("reported on", 95),
        ("report date", 95),
        ("observation date", 95),
        ("incident date", 95),
        ("date of report", 95),
        ("date of observation", 95),
        ("date of incident", 95),
        ("reported date", 95),
        ("when", 40),
        ("created on", 70),
        ("created at", 60),
    ],
    "site": [
        ("site", 100),
        ("site name", 120),
        ("location", 95),
        ("plant", 90),
        ("facility", 85),
        ("installation", 85),
        ("area", 60),
        ("region", 60),
        ("unit", 45),
        ("department", 45),
        ("place", 45),
        ("work location", 100),
        ("location of work", 100),
        ("location name", 100),
    ],
    "activity": [
        ("activity", 95),
        ("nature of work", 110),
        ("type of work", 100),
        ("type of job", 100),
        ("kind of work", 100),
        ("task", 75),
        ("job", 65),
        ("operation", 70),
        ("work type", 85),
        ("activity performed", 95),
        ("work performed", 85),
        ("work", 40),
    ],
    "report_type": [
        ("report type", 110),
        ("type of report", 110),
        ("observation type", 105),
        ("incident type", 105),
        ("near miss type", 105),
        ("category", 95),
        ("classification", 90),
        ("type", 70),
        ("kind", 60),
        ("nature of report", 90),
    ],
    "report_id": [
        ("report id", 120),
        ("report no", 115),
        ("report number", 115),
        ("id", 70),
        ("ref no", 110),
        ("reference no", 105),
        ("reference", 60),
        ("incident id", 110),
        ("incident no", 105),
        ("incident number", 105),
        ("observation id", 110),
        ("observation no", 105),
        ("near miss id", 110),
        ("near miss no", 105),
        ("record id", 100),
        ("sr no", 100),
        ("serial no", 90),
        ("ticket no", 90),
        ("safety observation no", 110),
    ],
    "hazard": [
        ("hazard", 110),
        ("hazard category", 120),
        ("hazard type", 115),
        ("hazard description", 100),
        ("potential hazard", 100),
        ("risk category", 90),
        ("risk type", 85),
        ("danger", 60),
    ],
    "rule": [
        ("life saving rule", 130),
        ("life-saving rule", 130),
        ("lsr", 120),
        ("lifesaving rule", 130),
        ("rule", 70),
        ("safety rule", 110),
    ],
    "consequence": [
        ("potential consequence", 120),
        ("consequence", 110),
        ("impact", 70),
    ],
    "barrier_failure": [
        ("barrier failure", 130),
        ("failed barrier", 120),
        ("barrier", 80),
    ],
    "location": [
        ("location detail", 120),
        ("specific location", 115),
        ("work location", 100),
    ],
    "equipment": [
        ("equipment", 120),
        ("tool", 70),
        ("asset", 65),
    ],
    "unsafe_type": [
        ("unsafe type", 120),
        ("unsafe act", 110),
        ("unsafe condition", 110),
    ],
}

# Hints for a text column nothing else claimed.
TEXT_HINTS = ["report", "description", "narrative", "observation", "detail", "summary"]

# Rule implied by hazard or activity wording, first hit wins.
RULE_FIELD_HINTS = [
    ("Energy Isolation", ["isolat", "loto", "lockout", "tagout", "energ", "residual pressure", "de-energ"]),
    ("Confined Space Entry", ["confined", "vessel", "manhole", "gas test", "attendant"]),
    ("Hot Work Safety", ["hot work", "welding", "cutting", "grinding", "spark", "ignition"]),
    ("Working at Height", ["height", "fall", "ladder", "scaffold", "roof", "platform"]),
    ("Safe Mechanical Lifting", ["lifting", "crane", "rigging", "sling", "hoist", "suspended"]),
    ("Line of Fire", ["line of fire", "stored energy", "kickback", "swing", "pressurized"]),
    ("Toxic Gas Safety", ["toxic", "gas leak", "h2s", "hydrogen sulfide", "asphyx", "ventilation", "oxygen"]),
    ("Driving Safety", ["driving", "vehicle", "driver", "transport", "road", "traffic"]),
    ("Work Authorization", ["permit", "ptw", "authorization"]),
    ("Bypassing Safety Controls", ["bypass", "defeat", "override", "disable", "interlock"]),
]
