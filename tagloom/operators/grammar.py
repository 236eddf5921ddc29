"""The tag grammar as data: patterns by rank, code sets and sizes. All fixed values."""

from __future__ import annotations

# Instrument function codes.
INSTRUMENT_CODES = (
    "PIT PDT PDIT PDIC PDIS PDS PDR PDC PDI PT PI PIC PCV PSV PSH PSL PRV PV PAH PAL PE PC PS PR PY PVI PVR "
    "TIT TDT TDIT TDIC TT TI TIC TCV TSH TSL TE TAH TAL TC TS TR TY TW TDI TDR "
    "FIT FDT FDIT FT FI FIC FCV FE FRC FO FSL FSH FAL FC FS FR FY FDI FDR FG "
    "LIT LDT LDIT LT LI LIC LCV LSH LSL LE LAH LAL LC LS LR LY LG LDI LDR LV "
    "AIT ADT ADIT AT AI AIC ACV AAH AAL AC AS AR AY AE AV VIT VT VI VIC VAH VAL VE VS VR VY VSD VD "
    "ZIT ZT ZI ZIC ZCV ZE ZS ZR ZY ZV WIT WT WI WIC WE WS WR WY EIT ET EI EIC EE ES ER EY JIT JT JI JIC JE JS JR JY "
    "SIT ST SI SIC SE SS SR SY SH SL HIT HT HI HIC HV HS HC HY XIT XT XI XE XV XS XR XY XC GIT GT GI GIC GE GS GR GY GC "
    "MCC UCP OMS ESD PLC DCS SIS FGS SCADA BMS"
).split()
# Two-letter codes that are no instruments when bare.
AMBIGUOUS_CODES = "AC AS GC FC SC VC DC RC WF PV TV LV AV FV ZV".split()
# Equipment codes behind an area number.
EQUIPMENT_CODES = "KA KB KC KT CP CM HA HB HC EA EB EC HX HE VA VB VC TA TB TK DA DB CA CB PA PB PC GA GB PM PU FA FB FC SA SB SC CX FL SE ST KZ ME MA MB NA NB SK PK PKG GH GJ KD KE LA LB".split()
# Prefixes of bare equipment tags.
EQUIPMENT_PREFIXES = "K KA KB KC KT CM CP MT MG E EA EB HX HE BA V VA VB TK T D DA C R DR P PA PB PC G GA PM PU F FA FB ST CX SK PK M MA MB U UA W WA".split()
# Valve codes behind an area number.
VALVE_CODES = "CB GB BL GT BT GL NV".split()
# Nominal sizes.
INCH_SIZES = "1/2 3/4 1 1-1/4 1-1/2 2 2-1/2 3 4 6 8 10 12 14 16 18 20 24".split()
MM_SIZES = [f"{n}mm" for n in (15, 20, 25, 32, 40, 50, 65, 80, 100, 125, 150, 200, 250, 300, 350, 400, 450, 500, 600)]
# Pipe specification and service codes, which are no tags.
SPEC_CODE = r"(?i)^(?:GC|AC|AS|FC|VC|SC|DC|WF|RC|CC|SG|CS|AG)[0-9A-Z]{2,6}$"
SERVICE_CODE = r"(?i)^[A-Z]{1,4}-[0-9]{2}$"
EQUIPMENT_REJECT = r"(?i)^(?:FC|GC|AC|AS|VC|SC|DC|WF|PV|VF|VA|HC|RC)[0-9]"

SAFE_CODES = sorted((c for c in INSTRUMENT_CODES if len(c) >= 3 or c not in AMBIGUOUS_CODES), key=lambda c: (-len(c), c))

# Patterns in the order in which they are tried; group 1 is the tag.
PATTERNS: list[tuple[int, str, str]] = [
    (1, "PSV_TAG", r"(?i)\b(\d{0,4}-?PSV-\d{3,5}[A-Z]?)\b"),
    (2, "LINE_TAG", r"""(?i)((?:\d+(?:[/\.]\d+)?(?:["']|mm|DN)?\s*[-–]?\s*)?[A-Z]{1,4}\s*[-–]\s*(?:\d{2,4}\s*[-–]\s*)?\d{3,5}\s*[-–]\s*[A-Z0-9]{2,8}(?:\s*[-–]\s*[A-Z0-9]{1,8})?)"""),
    (3, "PROJECT", r"(?i)\b(\d{2}-(?:[A-Z]{2,4})-(?:[0-9A-Z]{3,6})(?:-[A-Z]{1,4}\d{1,4})?)\b"),
    (4, "INSTRUMENT_TAG", rf"(?i)\b((?:{'|'.join(SAFE_CODES)})-\d{{3,5}}[A-Z]?)\b"),
    (5, "VALVE_TAG", r"(?i)\b(\d{2}-?[A-Z]{2}-?\d{4,6}[A-Z]?|(?:HV|XV|CV|PCV|FCV|TCV|LCV|EV|MOV|SDV|BDV|FV|UV|TV|LV|AV|ZV)[-–]\d{2,5}[A-Z]?|(?:BV|NV|GV|BFV|SBV|NGV|PLV|RV|PRV)[-–]\d{2,5}[A-Z]?|\bV-\d{3,5}[A-Z]?)\b"),
    (6, "EARTH_BAR_TAG", r"(?i)\b((?:EBM|MEB|EEB|SEB|PEB|EGB|MGB|GBB|EB|EBB)[-–]?\d{1,4}[A-Z]?|MAIN\s+EARTH\s+BAR(?:\s*[-–]?\s*\d{1,4}[A-Z]?)?|EARTH\s+(?:BAR|BUSBAR|BUS|STRIP\s+BAR)(?:\s*[-–]?\s*[A-Z0-9]{1,4})?|GROUND\s+(?:BAR|BUSBAR|BUS)(?:\s*[-–]?\s*[A-Z0-9]{1,4})?|EARTHING\s+(?:BAR|BUSBAR|BUS)(?:\s*[-–]?\s*[A-Z0-9]{1,4})?)\b"),
    (7, "EARTH_PIT_TAG", r"(?i)\b((?:EP|EE|ER|GP|ELP)[-–]?\d{1,4}[A-Z]?|EARTH\s+(?:PIT|CHAMBER|ELECTRODE|WELL|ROD)(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|GROUND(?:ING)?\s+(?:PIT|CHAMBER|ELECTRODE|WELL)(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|EARTH\s+TEST\s+PIT|TEST\s+(?:PIT|LINK|CHAMBER)|DISCONNECTING\s+LINK)\b"),
    (8, "BOND_CONDUCTOR_TAG", r"(?i)\b((?:BC|EC|EBC|GBC|GC-)[-–]?\d{1,4}[A-Z]?|COPPER\s+(?:TAPE|STRIP|CONDUCTOR|WIRE|CABLE)|CU\s+(?:TAPE|STRIP|CONDUCTOR)|(?:GS|GI|MS)\s+(?:FLAT|STRIP|TAPE)|EARTHING\s+(?:CONDUCTOR|STRIP|TAPE|GRID|MAT|LEAD)|GROUNDING\s+(?:CONDUCTOR|STRIP|TAPE|GRID|MAT|LEAD)|\d{2,3}\s*[xX]\s*\d{1,2}\s*(?:MM|MM2|SQMM)|\d{2,3}\s*(?:SQMM|SQ\.MM|MM2))\b"),
    (9, "PANEL_TAG", r"(?i)\b((?:EMDB|MVDB|LVDB|LPDB|EPDB|MDB|LDB|SDB|DB|PDB|NDB|MSB|LSB|ESB|SMDB|MLP|ELP|SLP|LP|MCC|PCC|PDP|PDPB)\s*[-–/]?\s*[A-Z0-9]{1,6}|LIGHTING\s+PANEL(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|DISTRIBUTION\s+BOARD(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|EARTHING\s+PANEL(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|SWITCHBOARD(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?|SWITCHGEAR(?:\s*[-–/]?\s*[A-Z0-9]{1,4})?)\b"),
    (10, "CIRCUIT_TAG", r"(?i)\b((?:MCB|RCCB|MCCB|ACB|VCB|CB|CK|CIRCUIT|C)-\d{1,4}[A-Z]?)\b"),
    (11, "LUMINAIRE_TAG", r"(?i)\b((?:TL|FL|EL|SL|LS|WL|LT|LP|LGT|FIX|LED|EML|WGL)[-–]?\d{1,4}[A-Z]?|L-\d{1,4}[A-Z]?|FLOODLIGHT(?:-?\d{1,4}[A-Z]?)?|WELLGLASS(?:-?\d{1,4}[A-Z]?)?|LUMINAIRE(?:-?\d{1,4}[A-Z]?)?|LIGHT\s+FIXTURE(?:-?\d{1,4}[A-Z]?)?|LIGHTING\s+FITTING(?:-?\d{1,4}[A-Z]?)?|HIGH\s*BAY(?:-?\d{1,4}[A-Z]?)?|LOW\s*BAY(?:-?\d{1,4}[A-Z]?)?|EMERGENCY\s+LIGHT(?:-?\d{1,4}[A-Z]?)?)\b"),
    (12, "EQUIPMENT_TAG", r"(?i)\b([A-Z]{1,3}-\d{2,5}[A-Z]?(?:/[A-Z])?)\b"),
    (13, "ELEVATION_TAG", r"(?i)\b((?:EL|TL|RL|BL|GL|FFL|SFL)\s*[.:]?\s*[+\-]?\d{2,5}(?:\.\d{1,3})?)\b"),
    (14, "RATING", r"(?i)\b(\d{2,4}(?:#|#\s|barg|psig|kpag|bar|mpa|kpa))\b"),
]
# Words beside which a three-digit instrument is a set point.
SETPOINT = r"(?i)\b(?:SD|HH|LL|HIGH\s*HIGH|LOW\s*LOW|TRIP|SHUT\s*DOWN|SP\s*=|SET\s*PRESS(?:URE)?|SETPOINT|MAX(?:IMUM)?|MIN(?:IMUM)?|DESIGN|MAWP|MAPD|MOP|MAOP|BARG|BAR\(G\)|PSIG|KPAG|MPA(?:G)?|\d+\.\d+\s*BAR|\d+\s*°[CF]|\d+\s*DEG(?:REE)?|H\s*:|L\s*:|HH\s*:|LL\s*:|ALARM|INTERLOCK)"
# Sort order of the classes.
PRIORITY = {c: i for i, c in enumerate("EQUIPMENT_TAG LINE_TAG INSTRUMENT_TAG PSV_TAG VALVE_TAG PANEL_TAG CIRCUIT_TAG LUMINAIRE_TAG EARTH_BAR_TAG EARTH_PIT_TAG BOND_CONDUCTOR_TAG ELEVATION_TAG RATING NOTE".split())}
# Classes whose spellings are folded.
FOLDED = "INSTRUMENT_TAG VALVE_TAG EQUIPMENT_TAG PSV_TAG LINE_TAG".split()
