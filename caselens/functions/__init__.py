"""Column functions: each takes and gives columns, evaluated by Catalyst."""
