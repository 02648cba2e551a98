"""Operators for training-data pipelines. Nothing else in archspark imports this package."""

from . import ann_forest, bpe, langid, lattice, merkle, minhash, packing, periodic, pivot_index, quality, sharding, urlfilter, warc_zip

QUERIES = {
    f.__name__: f
    for f in (
        warc_zip.op1_warc_zip, ann_forest.op2_hash_prefix_forest, sharding.op3_jump_shards, bpe.op4_byte_bpe, minhash.op5_min_max_hash,
        urlfilter.op6_url_rules, quality.op7_additive_quality, lattice.op8_e8_lattice, packing.op9_best_fit_packing, langid.op10_ftrl_language,
        merkle.op11_mountain_manifest, pivot_index.op12_pivot_distance, periodic.op13_lag_runs,
    )
}

ORACLES = {
    "op1_warc_zip": warc_zip.ORACLE, "op3_jump_shards": sharding.ORACLE, "op5_min_max_hash": minhash.ORACLE, "op6_url_rules": urlfilter.ORACLE, "op8_e8_lattice": lattice.ORACLE,
    "op11_mountain_manifest": merkle.ORACLE, "op12_pivot_distance": pivot_index.ORACLE, "op13_lag_runs": periodic.ORACLE,
}
