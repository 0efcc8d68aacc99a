"""Fixed values shared by the jobs. Units are in the names; metres and degrees Celsius inside."""

# fixed values: data model
SAMPLE_SPACING_M = 10.0
AZIMUTH_BINS = 72
BIN_WIDTH_DEG = 5.0
HORIZON_LAYERS = 2
HORIZON_FORMAT_VERSION = 3

KIND_SIDEWALK, KIND_CROSSING = 0, 1
SIDE_NONE, SIDE_LEFT, SIDE_RIGHT = -1, 0, 1
AMENITY_FOUNTAIN, AMENITY_COOLING, AMENITY_PARK = 0, 1, 2

# fixed values: shade geometry
EYE_HEIGHT_M = 1.1
RAY_CAP_M = 400.0
TAU_ELEVATION_DEG = 30.0
TAU_FLOOR = 1e-6

# fixed values: street geometry
FEET_TO_M = 0.3048
INCH_TO_CM = 2.54
SIDEWALK_OFFSET_M = 6.0
SIDEWALK_HALF_WIDTH_M = 2.0
MAX_STREET_WIDTH_FT = 120.0
MIN_EDGE_LENGTH_M = 3.0
NODE_SNAP_M = 1.0
WIDTH_SEARCH_M = 12.0
CROSSING_MAX_SPAN_M = 40.0
CROSSING_KEEP_SPAN_M = 15.0

# fixed values: walking
WALK_SPEED_MS = 1.35
CROSSING_PENALTY_S = 20.0
DETOUR_FACTOR = 1.7
DETOUR_SLACK_S = 120.0
MAX_EXTRA_S = 120.0
HEAT_EPSILON_DM = 0.1

# fixed values: rest stops
COMFORT_BASELINE_C = 26.0
LOAD_THRESHOLD_DM = 80.0
DETOUR_BUDGET_S = 150.0
MAX_STOPS = 2

# fixed values: scopes (name -> boroughs, west, south, east, north)
SCOPES = {
    "midtown": (("1",), (-74.0000, 40.7450, -73.9700, 40.7650)),
    "manhattan": (("1",), (-74.0250, 40.6980, -73.9060, 40.8830)),
    "manhattan_brooklyn": (("1", "3"), (-74.0500, 40.5700, -73.8330, 40.8830)),
}

# fixed values: boxes of islands that the walking network does not reach
ISLAND_BOXES = (
    (-73.9650, 40.7480, -73.9380, 40.7760),
    (-73.9400, 40.7810, -73.9100, 40.8050),
    (-74.0280, 40.6840, -74.0100, 40.6960),
    (-73.9150, 40.8720, -73.9000, 40.8850),
)

# fixed values: source filters
WALKABLE_ROAD_TYPES = ("1", "6", "7", "10")
BUILDING_FEATURE_CODES = ("2100", "5110")
KNOWN_BOROUGHS = ("1", "2", "3", "4", "5")
MIN_BUILDING_HEIGHT_M = 2.0
MAX_DBH_IN = 60.0
PARK_CLASSES = ("PARK", "NATURE AREA", "HISTORIC HOUSE PARK", "COMMUNITY PARK")
PARK_EXCLUDED_CATEGORIES = (
    "Parkway", "Undeveloped", "Strip", "Tracking", "Buildings/Institutions", "Lot", "Mall",
)
MIN_PARK_ACRES = 0.25
PARK_BOUNDARY_STEP_M = 15.0
PARK_SIDEWALK_REACH_M = 15.0
PARK_GATE_SEPARATION_M = 80.0
PLACE_NAME_COLUMNS = (
    "name", "site_name", "park_name", "propertyname",
    "propertyna", "signname", "decription", "description",
)
PARK_NAME_COLUMNS = ("signname", "name311", "location")

# fixed values: land cover class -> ground albedo
CLASS_ALBEDO = {1: 0.18, 2: 0.21, 3: 0.20, 4: 0.07, 5: 0.15, 6: 0.12, 7: 0.25}
DEFAULT_LANDCOVER_CLASS = 7
DEFAULT_ALBEDO = 0.25

# fixed values: heat profiles, minutes of extra walking one degree is worth
HEAT_PROFILES = {"standard": 1.0, "sensitive": 3.0, "high risk": 6.0}
