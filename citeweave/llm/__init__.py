"""Training-data operators: one module each, general interface first, thin query last."""
