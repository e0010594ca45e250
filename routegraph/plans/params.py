"""Question parameters for the registered queries.

Fixed values. The reference hand-picks airports by id after looking them up by name
(Turin, Los Angeles, Tancredo Neves) and two carriers (by code); these are the roles'
counterparts in the derived test network, plus thresholds sized for its scale (the
reference's "> 200 airports" would keep no country below sf0.1).
"""

COUNTRY_THRESHOLD = 50  # countries with more than this many coded airports
TOP_AIRLINES = 10
TOP_ROUTES = 5
TOP_RATIO = 5
HUB = 5  # "Turin": reach-in/out queries
LOOKUP_NAME = "Customer#000000005"  # name lookup of the hub
LANDMARK_A = 1  # "Los Angeles"
LANDMARK_B = 5  # "Turin"
NO_RETURN_ORIGIN = 7  # "Tancredo Neves": no-return motif and distances
CARRIERS = ("C1", "C2")  # two carriers for the drawn subgraph
MIN_CITIES = 5
MIN_COMPONENT_SIZE = 2
RANK_ROUNDS = 10  # rounds of PageRank
LABEL_ROUNDS = 3  # rounds of label propagation
CLICK_WINDOW_S = 300  # errors no later than this after a click
