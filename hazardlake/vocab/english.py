"""Fixed English vocabulary of the safety lexicon.

Every block below is a fixed value: the detector only gives the expected
results with exactly these words in exactly this order.  An indicator is a
phrase and whether it counts only beside a negation.
"""

# Rule profiles, in rule order (the order breaks ties).
RULES = [
    {
        "name": 'Energy Isolation',
        "description": 'Verify isolation and ensure zero energy before work begins.',
        "hazard": 'Uncontrolled energy',
        "consequence": 'Serious injury or fatality from unexpected release of hazardous energy (mechanical, electrical, pressure, thermal)',
        "barriers": ['Energy Isolation / LOTO', 'Permit to Work'],
        "follow_up": 'Verify isolation and lockout/tagout controls before maintenance begins.',
    },
    {
        "name": 'Confined Space Entry',
        "description": 'Always obtain authorization and test the atmosphere before entering a confined space.',
        "hazard": 'Confined-space hazards (oxygen deficiency, toxic atmosphere)',
        "consequence": 'Serious injury or fatality from oxygen deficiency, toxic gas or engulfment',
        "barriers": ['Gas Testing', 'Confined-Space Entry Permit', 'Standby Attendant', 'Rescue Equipment'],
        "follow_up": 'Verify atmospheric testing, entry permit, standby attendant and rescue arrangements before confined-space entry.',
    },
    {
        "name": 'Hot Work Safety',
        "description": 'Control flammable materials and ignition sources when performing hot work.',
        "hazard": 'Fire / explosion',
        "consequence": 'Serious injury or fatality from fire or explosion',
        "barriers": ['Hot-Work Permit', 'Fire Watch', 'Gas Testing', 'Housekeeping / Combustible Control'],
        "follow_up": 'Verify hot-work permit, fire watch, gas testing and combustible control before starting hot work.',
    },
    {
        "name": 'Working at Height',
        "description": 'Protect yourself against falls when working at height.',
        "hazard": 'Fall from height',
        "consequence": 'Serious injury or fatality from a fall from height',
        "barriers": ['Fall Protection', 'Scaffolding / Guardrails', 'Barricading'],
        "follow_up": 'Verify fall protection, edge protection and secure access before working at height.',
    },
    {
        "name": 'Line of Fire',
        "description": 'Keep yourself and others out of the line of fire during operations.',
        "hazard": 'Struck-by / line of fire',
        "consequence": 'Serious injury or fatality from being struck by moving objects, released energy or dropped loads',
        "barriers": ['Barricading', 'Safe Positioning', 'Exclusion Zones'],
        "follow_up": 'Verify safe positioning and exclusion zones to keep personnel out of the line of fire.',
    },
    {
        "name": 'Safe Mechanical Lifting',
        "description": 'Plan lifting operations carefully and control the area to prevent accidents.',
        "hazard": 'Suspended load / lifting failure',
        "consequence": 'Serious injury or fatality from dropped or uncontrolled loads',
        "barriers": ['Lifting Plan', 'Sling Inspection', 'Banksman', 'Load Chart'],
        "follow_up": 'Verify the lifting plan, equipment inspection, load chart and banksman before the lift.',
    },
    {
        "name": 'Driving Safety',
        "description": 'Adhere to safe driving rules to prevent collisions and protect pedestrians.',
        "hazard": 'Vehicle collision / pedestrian impact',
        "consequence": 'Serious injury or fatality from a vehicle collision or pedestrian impact',
        "barriers": ['Vehicle Controls', 'Speed Limits', 'Spotter'],
        "follow_up": 'Verify vehicle controls, speed limits and pedestrian segregation for vehicle movements.',
    },
    {
        "name": 'Toxic Gas Safety',
        "description": 'Monitor air quality and follow procedures when working with toxic gases such as H2S.',
        "hazard": 'Toxic gas exposure',
        "consequence": 'Serious injury or fatality from toxic gas exposure (e.g. H2S, benzene)',
        "barriers": ['Gas Detector', 'Atmospheric Monitoring', 'SCBA / Escape Sets', 'Wind Direction'],
        "follow_up": 'Verify gas detection, monitoring and escape equipment before working where toxic gas may be present.',
    },
    {
        "name": 'Bypassing Safety Controls',
        "description": 'Obtain authorization before overriding or disabling any safety controls.',
        "hazard": 'Defeated safety controls',
        "consequence": 'Serious injury or fatality from contact with hazards normally controlled by guards or interlocks',
        "barriers": ['Machine Guarding', 'Safety Interlocks', 'Emergency Stop'],
        "follow_up": 'Restore machine guarding, interlocks and emergency-stop controls before resuming work.',
    },
    {
        "name": 'Work Authorization',
        "description": 'Always work with a valid permit when required.',
        "hazard": 'Unauthorized work / missing controls',
        "consequence": 'Serious injury or fatality from work performed without required controls',
        "barriers": ['Permit to Work', 'Gas Testing', 'PTW'],
        "follow_up": 'Verify a valid permit to work and required controls before the activity starts.',
    },
]

# Indicator phrases per rule, and whether they count only beside a negation.
INDICATORS = {
    'Energy Isolation': [
        ('without isolating', False),
        ('failed to isolate', False),
        ('did not isolate', False),
        ('not isolated', False),
        ('no isolation', False),
        ('no lockout', False),
        ('without lockout', False),
        ('without tagout', False),
        ('no tagout', False),
        ('lockout not', False),
        ('lockout was missing', False),
        ('loto tag was missing', False),
        ('bypassed the lockout', False),
        ('defeated the lockout', False),
        ('bypassed the isolation', False),
        ('still energized', False),
        ('still energised', False),
        ('without de-energiz', False),
        ('not de-energiz', False),
        ('without depressuriz', False),
        ('not depressuriz', False),
        ('under pressure', False),
        ('pressurized', False),
        ('pressurised', False),
        ('live line', False),
        ('live pipeline', False),
        ('isolat', True),
        ('lockout', True),
        ('tagout', True),
        ('energiz', True),
        ('de-energiz', True),
        ('live panel', False),
        ('live wire', False),
        ('live circuit', False),
        ('energized circuit', False),
        ('energised circuit', False),
        ('without switching off', False),
        ('not switched off', False),
        ('exposed live wires', False),
        ('no barricade', False),
        ('without barricade', False),
        ('electrician', True),
        ('electrical', True),
        ('circuit', True),
        ('breaker', True),
        ('voltage', True),
        ('rated gloves', True),
    ],
    'Confined Space Entry': [
        ('without gas test', False),
        ('without gas testing', False),
        ('no gas test', False),
        ('no gas testing', False),
        ('not tested for gas', False),
        ('no atmospheric test', False),
        ('oxygen levels', True),
        ('gas testing', True),
        ('gas test', True),
        ('confined space', True),
        ('entered the tank', False),
        ('entered the vessel', False),
        ('tank entry', False),
        ('vessel entry', False),
        ('manhole', True),
        ('standby man', True),
        ('rescue equipment', True),
    ],
    'Hot Work Safety': [
        ('without hot work permit', False),
        ('no hot work permit', False),
        ('hot work', True),
        ('welding', True),
        ('welded', True),
        ('grinding', True),
        ('sparks', False),
        ('cutting torch', False),
        ('oxy-acetylene', False),
        ('near fuel', False),
        ('fuel storage', False),
        ('combustible', False),
        ('flammable', False),
        ('hot work permit', True),
        ('fire watch', True),
    ],
    'Working at Height': [
        ('working at height', True),
        ('work at height', True),
        ('without a harness', False),
        ('without harness', False),
        ('no harness', False),
        ('no fall protection', False),
        ('without fall protection', False),
        ('lacked guardrails', False),
        ('no guardrails', False),
        ('open edge', False),
        ('open pit', False),
        ('dropped from', False),
        ('dropped object', False),
        ('climbed the ladder', False),
        ('without anyone holding', False),
        ('harness', True),
        ('fall protection', True),
        ('guardrail', True),
        ('guard rails', True),
        ('scaffold', True),
        ('ladder', True),
        ('roof', True),
        ('elevated', True),
    ],
    'Line of Fire': [
        ('line of fire', False),
        ('in the path', False),
        ('under the suspended load', False),
        ('walked under', False),
        ('stood under', False),
        ('near the moving', False),
        ('while the crane', False),
        ('whipped', False),
        ('whipping', False),
        ('reversing', False),
        ('pressure test', False),
        ('blowback', False),
        ('blew off', False),
        ('almost hit', False),
        ('nearly hit', False),
    ],
    'Safe Mechanical Lifting': [
        ('beyond its rated capacity', False),
        ('overloaded', False),
        ('no banksman', False),
        ('without banksman', False),
        ('raised load', False),
        ('suspended load', True),
        ('crane', True),
        ('sling', True),
        ('lifting', True),
        ('lifted', True),
        ('forklift', True),
        ('rigging', True),
        ('hoist', True),
        ('load chart', True),
        ('banksman', True),
    ],
    'Driving Safety': [
        ('speeding', False),
        ('nearly hit the pedestrian', False),
        ('almost hit the pedestrian', False),
        ('reversing', False),
        ('reversed', False),
        ('without a spotter', False),
        ('no spotter', False),
        ('did not follow the speed limit', False),
        ('tanker', True),
        ('tanker', True),
        ('vehicle', True),
        ('truck', True),
        ('driver', True),
        ('pedestrian', True),
        ('loading bay', True),
        ('yard', True),
        ('collision', True),
        ('blind spot', True),
    ],
    'Toxic Gas Safety': [
        ('hydrogen sulfide', False),
        ('h2s', False),
        ('sour gas', False),
        ('sour crude', False),
        ('toxic gas', False),
        ('no gas detector', False),
        ('without gas detector', False),
        ('gas detector not worn', False),
        ('no scba', False),
        ('without breathing apparatus', False),
        ('benzene exposure', False),
        ('gas leak', False),
        ('gas alarm', False),
        ('h2s alarm', False),
        ('detector', True),
        ('breathing apparatus', True),
        ('gas detector', True),
        ('gas monitoring', True),
        ('h2s', True),
    ],
    'Bypassing Safety Controls': [
        ('bypassed', False),
        ('defeated the interlock', False),
        ('guard was removed', False),
        ('guard was missing', False),
        ('guard removed', False),
        ('removed the guard', False),
        ('interlock was defeated', False),
        ('emergency stop', True),
        ('interlock', True),
        ('machine guard', True),
        ('guard', True),
        ('disabled', True),
    ],
    'Work Authorization': [
        ('without permit', False),
        ('without a permit', False),
        ('no permit', False),
        ('without shoring', False),
        ('no shoring', False),
        ('without authorisation', False),
        ('without authorization', False),
        ('not authorized', False),
        ('unauthorized work', False),
        ('unauthorised work', False),
        ('excavation', True),
        ('trench', True),
        ('shoring', True),
        ('buried', True),
        ('permit to work', True),
        ('ptw', True),
    ],
}

# Tokens that mark a control as failed or missing.
NEGATION_TOKENS = [
    "no ",
    "not ",
    "without ",
    "never ",
    "failed ",
    "failure",
    "missing",
    "lack of",
    "bypass",
    "bypassed",
    "defeat",
    "defeated",
    "disabled",
    "removed",
    "did not",
    "didn't",
    "wasn't",
    "unsecured",
    "blocked",
]

# Positive outcomes removed from a window before negations are sought.
NULLIFY_PHRASES = [
    "no incident",
    "no incidents",
    "no issue",
    "no issues",
    "no problem",
    "no problems",
    "no hazard",
    "no danger",
    "no injury",
    "no injuries",
    "no damage",
    "no findings",
    "no harm",
    "not reported",
    "no near miss",
]

# Wording that puts people near the hazard.
EXPOSURE_TERMS = [
    "worker",
    "workers",
    "technician",
    "crew",
    "operator",
    "driver",
    "electrician",
    "welder",
    "personnel",
    "employee",
    "staff",
    "entered",
    "stood",
    "walked",
    "working",
    "worked",
    "exposed",
    "near",
    "while",
    "during",
    "started",
    "began",
    "hit",
    "struck",
    "near-miss",
    "near miss",
    "incident",
    "almost hit",
    "nearly hit",
    "was present",
    "in the area",
    "on site",
]

# Further words for a broken or absent control.
CONTROL_FAILURE_WORDS = [
    "damaged",
    "broken",
    "defective",
    "collapsed",
    "expired",
    "faulty",
    "unstable",
    "absent",
    "blocked",
    "jammed",
    "corroded",
    "fell",
    "toppled",
    "lacked",
    "lacking",
    "unsafe",
    "improper",
    "not safe",
    "not proper",
    "not provided",
    "not installed",
    "not fitted",
    "defeated",
]

# Romanised negations met beside English control terms.
FOREIGN_NEGATION_TOKENS = [
    "nahi",
    "nhi",
    "bina",
    "chara",
    "hoyni",
    "kora hoyni",
    "nokori",
    "nokora",
    "nokorakoi",
    "nipindha",
    "nipindhakoi",
    "nai thakil",
    "nai",
    "jodi na",
    "chilo na",
    "pora hoyni",
    "hata diya",
    "khule diye",
]

# People who can act unsafely.
ACT_ACTORS = [
    "worker",
    "workers",
    "technician",
    "crew",
    "operator",
    "driver",
    "electrician",
    "welder",
    "employee",
    "personnel",
    "contractor",
]

# Wording of an unsafe condition.
CONDITION_WORDS = [
    "leak",
    "missing",
    "damaged",
    "defective",
    "exposed",
    "unguarded",
    "not provided",
    "no barricade",
    "unsecured",
    "blocked",
]

# Barrier label and its terms.
BARRIER_TERMS = {
    "Energy Isolation / LOTO": ["loto", "lockout", "tagout", "isolat"],
    "Gas Testing": ["gas test", "gas testing", "atmospheric test"],
    "Permit to Work": ["permit", "ptw", "work authorisation", "work authorization"],
    "Fall Protection": ["harness", "fall protection", "guardrail", "guard rail", "guardrails"],
    "Barricading": ["barricade", "barricading", "barricades", "exclusion zone", "caution tape"],
    "Machine Guarding": ["machine guard", "guard", "guarding", "interlock"],
    "Vehicle Controls": ["spotter", "speed limit", "mirrors"],
    "PPE": ["ppe", "helmet", "gloves", "goggles"],
    "Fire Watch": ["fire watch"],
    "Housekeeping / Combustible Control": ["combustible", "flammable", "housekeeping"],
}

# Hazards noticed without a rule match.
EXTRA_HAZARDS = {
    "Fire / explosion": ["fire", "explosion", "explosive", "flammable", "smoke"],
    "Toxic / chemical exposure": ["toxic", "chemical", "hydrogen sulfide", "h2s", "fumes"],
    "High-pressure release": ["high pressure", "high-pressure", "pressure release", "leak"],
    "Moving machinery": ["rotating", "conveyor", "machine", "shaft"],
    "Dropped object": ["dropped", "falling object", "falling tool"],
}

# Activities, most specific first.
ACTIVITY_TERMS = {
    "Confined-space entry": ["confined space", "entered the tank", "entered the vessel", "inside the tank", "within the tank", "tank entry", "vessel entry", "manhole"],
    "Electrical work": ["electrician", "electrical", "live panel", "live wire", "breaker", "circuit", "voltage"],
    "Hot work": ["hot work", "welding", "welded", "weld", "grinding", "torch", "sparks", "oxy-acetylene"],
    "Working at height": ["scaffold", "ladder", "roof", "elevated", "working at height", "work at height", "harness", "height", "open pit"],
    "Lifting operations": ["crane", "forklift", "hoist", "sling", "lifting", "lifted", "rigging", "banksman"],
    "Excavation": ["excavation", "excavating", "trench", "digging", "shoring"],
    "Pipeline work": ["pipeline", "pipe", "flange", "pigging"],
    "Driving": ["driving", "driver", "vehicle", "tanker", "truck", "reversing", "yard", "pedestrian"],
    "Maintenance": ["maintenance", "repair", "overhaul", "servicing", "service", "technician", "mechanic", "job", "machine", "shaft"],
    "Material handling": ["chemical", "drum"],
}

# Equipment label and its terms.
EQUIPMENT_TERMS = {
    "Pipeline": ["pipeline", "pipe", "flange", "line"],
    "Pump": ["pump"],
    "Compressor": ["compressor"],
    "Vessel / Tank": ["vessel", "tank"],
    "Crane": ["crane"],
    "Forklift": ["forklift"],
    "Ladder": ["ladder"],
    "Scaffolding": ["scaffold"],
    "Valve": ["valve"],
    "Generator": ["generator"],
    "Boiler": ["boiler"],
    "Drill": ["drill"],
    "Hose": ["hose"],
    "Gas cylinder": ["cylinder"],
    "Electrical panel": ["panel", "breaker", "circuit"],
    "Conveyor": ["conveyor"],
}

# First hit gives the work area.
LOCATION_TERMS = [
    ("loading bay", "Loading bay"),
    ("control room", "Control room"),
    ("pump room", "Pump room"),
    ("pump house", "Pump room"),
    ("compressor room", "Compressor room"),
    ("compressor house", "Compressor room"),
    ("workshop", "Workshop"),
    ("rooftop", "Roof / elevated work area"),
    ("on the roof", "Roof / elevated work area"),
    ("roof", "Roof / elevated work area"),
    ("scaffolding", "Elevated work area (scaffold)"),
    ("scaffold", "Elevated work area (scaffold)"),
    ("tank farm", "Tank farm"),
    ("storage tank", "Storage tank area"),
    ("inside the tank", "Storage tank area"),
    ("within the tank", "Storage tank area"),
    ("tank", "Storage tank area"),
    ("vessel", "Vessel area"),
    ("manhole", "Confined-space entry point (manhole)"),
    ("pipeline", "Pipeline area"),
    ("piping", "Pipeline area"),
    ("excavation", "Excavation area"),
    ("excavating", "Excavation area"),
    ("trench", "Excavation area (trench)"),
    ("open pit", "Open pit / excavation"),
    ("pit", "Pit / excavation area"),
    ("yard", "Yard"),
    ("access road", "Access road"),
    ("highway", "Public highway"),
    ("road", "Access road"),
    ("jetty", "Jetty / dock"),
    ("wharf", "Jetty / dock"),
    ("dock", "Dock area"),
    ("rig floor", "Rig floor"),
    ("rig site", "Rig site"),
    ("well site", "Well site"),
    ("well pad", "Well pad"),
    ("drilling rig", "Drilling rig area"),
]

# Activity implied by a rule when the text is silent.
RULE_TO_ACTIVITY = {
    "Energy Isolation": "Isolation / LOTO work",
    "Confined Space Entry": "Confined-space entry",
    "Hot Work Safety": "Hot work",
    "Working at Height": "Working at height",
    "Line of Fire": "Load / equipment movement",
    "Safe Mechanical Lifting": "Lifting operations",
    "Driving Safety": "Driving",
    "Toxic Gas Safety": "Work in a toxic-gas environment",
    "Bypassing Safety Controls": "Machine operation / maintenance",
    "Work Authorization": "Permit-required work",
}

# Activity words that win over the vocabulary above.
EXPLICIT_ACTIVITIES = [
    ("Maintenance", ["maintenance", "servicing", "repair"]),
    ("Hot work", ["welding", "welded", "grinding", "hot work"]),
    ("Excavation", ["excavation", "excavating", "trench", "digging"]),
    ("Driving", ["driving", "reversing", "speeding"]),
    ("Electrical work", ["electrician", "electrical"]),
    ("Confined-space entry", ["confined space", "entered the tank", "entered the vessel"]),
    ("Working at height", ["working at height", "work at height"]),
]

# A phrase is void when one of these endings follows it.
FOLLOW_BLOCKS = {"guard": ["rail", "rails", "railings"]}

# Wording that signals a missing control when no match is negated.
MISSING_CONTROL_TERMS = ["without", "no ", "missing", "failed", "bypass", "defeat", "not provided", "lack"]

# Connectors that end a clause, tried in this order.
CLAUSE_CONNECTORS = [
    " and ", " but ", " so ", " while ", " whereas ", " although ", " though ",
    " however ", " ; ", " , ",
]

UNSAFE_ACT = "Unsafe Act"
UNSAFE_CONDITION = "Unsafe Condition"
