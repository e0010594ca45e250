"""Question catalogue: the network model, reports, registered queries and their SQL oracle."""
