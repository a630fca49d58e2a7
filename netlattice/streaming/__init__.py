"""No operator of this engine is a streaming one: its inputs are state dumps that are read whole.

The package is where such operators would go.
"""
