"""Small sources and expectations on which the source-text plans run without input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

USERS = """const express = require('express');
const router = express.Router();
const { User } = require('../models');

/**
 * @swagger
 * /api/crm/users:
 *   get:
 *     summary: List
 *     tags:
 *       - Users
 *     parameters:
 *       - name: page
 *         in: query
 *         required: true
 *         type: integer
 *         description: Page number
 *     responses:
 *       200:
 *         description: A page of users
 *       404:
 *         description: None
 */
router.get('/api/crm/users', auth, async (req, res) => {
  const { page = 1, limit } = req.query;
  const users = await User.find({ page });
  res.json({ users: users, total: 3 });
});

/**
 * @summary Create a user
 * @description Stores one user
 * @tags User, Admin
 * @param {string} name - User name
 * @param {number} [age] - Age in years
 * 201: Created
 * 400: Bad input
 */
router.post('/api/crm/users', [auth, validatePermission], (req, res) => {
  const { name, email } = req.body;
  UserService.create(name, email);
  axios.post('https://mail.example.com/send', { email });
  res.json({ id: 1 });
});

router.delete('/api/crm/users/:id', requireAuth, removeUser);
module.exports = router;
"""
ZONES = """@Controller('/api/crm/zones')
class ZoneController {
  @Get('/')
  findAll() { return Zone.findOne({ a: 1 }); }

  @Get('/:id')
  findOne() { fetch('https://geo.example.com/zone'); }
}
"""
BROKEN = "router.get('/api/crm/broken', (req, res => {\n"

#: (case, source): the evaluation's cases; fixed values, as their scores are.
CASES = (
    ("simple-express", "const express = require('express');\nconst router = express.Router();\n\nrouter.get('/api/users', handler);\nrouter.post('/api/users', handler);\nrouter.get('/api/users/:id', handler);\nrouter.put('/api/users/:id', handler);\nrouter.delete('/api/users/:id', handler);\n"),
    ("middleware-chains", "const router = express.Router();\n\nrouter.get('/api/users', auth, handler);\nrouter.post('/api/admin', [auth, validatePermission], handler);\nrouter.get('/api/sensitive', validatePermission([['admin', 'view']]), handler);\n"),
    ("nestjs-decorators", "@Controller('/users')\nclass UserController {\n  @Get('/')\n  findAll() {}\n\n  @Get('/:id')\n  findOne() {}\n\n  @Post('/')\n  create() {}\n}\n"),
    ("jsdoc-documentation", "const router = express.Router();\n\n/**\n * @summary Get all users\n * @description Returns a list of all users in the system\n * @tags User\n * @param {number} limit - Maximum number of results\n */\nrouter.get('/api/users', handler);\n"),
    ("openapi-generation", "const router = express.Router();\nrouter.get('/api/users/:id', handler);\n"),
)
#: (case, path, method, middleware_count, framework, has_docs, summary)
EXPECTED = (
    ("simple-express", "/api/users", "GET", None, None, None, None),
    ("simple-express", "/api/users", "POST", None, None, None, None),
    ("simple-express", "/api/users/:id", "GET", None, None, None, None),
    ("simple-express", "/api/users/:id", "PUT", None, None, None, None),
    ("simple-express", "/api/users/:id", "DELETE", None, None, None, None),
    ("middleware-chains", "/api/users", "GET", 1, None, None, None),
    ("middleware-chains", "/api/admin", "POST", 2, None, None, None),
    ("nestjs-decorators", "/users/", "GET", None, "nestjs", None, None),
    ("nestjs-decorators", "/users/:id", "GET", None, "nestjs", None, None),
    ("nestjs-decorators", "/users/", "POST", None, "nestjs", None, None),
    ("jsdoc-documentation", "/api/users", "GET", None, None, True, "Get all users"),
)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("users.js", USERS), ("zones.js", ZONES), ("broken.js", BROKEN)], "file string, src string")


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CASES), "file string, src string")


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPECTED), "case string, path string, method string, middleware_count int, framework string, has_docs boolean, summary string")
