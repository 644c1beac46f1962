"""Point-cloud analytics as keyed DataFrame relations.

Relations carry explicit keys (``cloud_id``, ``pid``, ``pair_id``), so that every operator runs over many clouds at once.
"""
